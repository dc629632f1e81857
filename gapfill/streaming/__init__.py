"""Progress of long fits and fills, reported while they run."""
