"""Training order on disk: a keyed permutation gives every sequence a slot, fixed-stride binary shards hold the slots."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapfill.llm.packing import pieces
from gapfill.llm.staging import staged
from gapfill.llm.textkit import mix, runs

SEQUENCE = 256
SHARD_ROWS = 1 << 16
ROUNDS = 6
SAMPLE = 1024


def _round_keys(key: int) -> np.ndarray:
    return mix(np.arange(1, ROUNDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ np.uint64(key & 0xFFFFFFFFFFFFFFFF))


def permute(x: np.ndarray, n: int, key: int, inverse: bool = False) -> np.ndarray:
    """A keyed permutation of ``0 .. n-1``: a Feistel network over the next even number of bits, walked until inside."""
    half = np.uint64(max(1, -(-max(1, int(n - 1).bit_length()) // 2)))
    low = np.uint64((1 << int(half)) - 1)
    keys = _round_keys(key)

    def once(v):
        left, right = v >> half, v & low
        for k in (keys[::-1] if inverse else keys):
            if inverse:
                left, right = right ^ (mix(left ^ k) & low), left
            else:
                left, right = right, left ^ (mix(right ^ k) & low)
        return left << half | right
    out = once(np.asarray(x, np.uint64))
    outside = np.flatnonzero(out >= n)
    while len(outside):
        out[outside] = once(out[outside])
        outside = outside[out[outside] >= n]
    return out.astype(np.int64)


def _filesystem(path: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _write(path: str, body: bytes) -> None:
    """All or nothing, so that a repeated task leaves the same file."""
    system, name = _filesystem(path)
    draft = f"{name}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as f:
        f.write(body)
    system.move(draft, name)


def _frequent_first(sample: list[bytes]) -> tuple[np.ndarray, np.ndarray, bytes]:
    """A renumbering of all 16-bit ids, those of a sample of 32-bit ids by falling frequency first, its inverse, and the renumbered sample."""
    ids = np.frombuffer(b"".join(sample), "<u4")
    ids = ids[ids <= 0xFFFF]
    back = np.argsort(-np.bincount(ids, minlength=1 << 16), kind="stable").astype("<u2")
    code = np.empty(1 << 16, "<u2")
    code[back] = np.arange(1 << 16)
    return code, back, code[ids].tobytes()


def materialise(docs: DataFrame, folder: str, key: int = 20240607, sequence: int = SEQUENCE, shard_rows: int = SHARD_ROWS,
                path: str | None = None, doc_id: str = "doc_id", text: str = "text", wide: bool = False) -> DataFrame:
    """Write the shards below ``folder``; (doc_id, piece, start, length, ids_crc32, slot, shard, byte_offset) per sequence.

    Every document's ids (and an end id 0) are cut into sequences of at most ``sequence`` ids. A sequence's number is its
    place in the staged table, its slot the permuted number: slots are 0 .. n-1 without gaps. ``shard-000007.bin`` holds
    slots ``7 * shard_rows`` on, one record of ``2 + 2 * sequence`` bytes each (16-bit length, ids, zeros; all 32-bit when
    ``wide``), so slot s is found by seeking and a reader resumes anywhere. ``manifest.json`` states the numbers.

    Defined results: null and empty texts are one sequence of the end id; repeated rows are written each; an empty table
    writes the manifest alone; other columns are not read. Shards are written aside and renamed.

    On the way 16-bit ids are renumbered by the frequencies of at most ``SAMPLE`` sequences, whose ids are the compression
    dictionary too: both only make the staged and shuffled copies smaller, whatever the sample holds.
    """
    size = 4 if wide else 2
    stride, kind = size * (sequence + 1), f"<u{size}"
    ids = pieces(docs, sequence, path, doc_id, text, with_ids=True)
    few = ids.select("ids").limit(SAMPLE).collect()
    code, back, like = _frequent_first([] if wide else [bytes(r[0]) for r in few])
    codes = docs.sparkSession.sparkContext.broadcast((code, back, like))

    def narrow(batches):
        code = codes.value[0]
        for batch in batches:
            body = [np.frombuffer(x, "<u4") for x in batch.column("ids").to_pylist()]
            if not wide and any(len(x) and int(x.max()) > 0xFFFF for x in body):
                raise ValueError("ids beyond 16 bits: use wide=True")
            yield batch.set_column(batch.schema.get_field_index("ids"), "ids", pa.array([(x.astype(kind) if wide else code[x]).tobytes() for x in body], pa.binary()))
    rows = staged(ids.mapInArrow(narrow, ids.schema), "sequences", level=9)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    # one number per file of the staged table, which is one per task that wrote it
    sizes = sorted(placed.groupBy("__file").agg(F.count(F.lit(1))).collect())
    starts = dict(zip([f for f, _ in sizes], np.concatenate([[0], np.cumsum([n for _, n in sizes])]).tolist()))
    total = sum(n for _, n in sizes)
    _system, name = _filesystem(folder)
    _system.create_dir(name, recursive=True)
    _write(f"{folder}/manifest.json", json.dumps({"sequences": total, "sequence": sequence, "stride": stride, "shard_rows": shard_rows,
                                                  "bytes_per_id": size, "key": key}).encode())
    known = docs.sparkSession.sparkContext.broadcast(starts)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def known_bytes(zstandard):
        like = codes.value[2]
        return zstandard.ZstdCompressionDict(like, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(like) >= 8 else None

    def deal(batches):
        import zstandard
        near = known_bytes(zstandard)
        if near:
            near.precompute_compress(level=6)
        pack = zstandard.ZstdCompressor(level=6, dict_data=near).compress
        for batch in batches:
            file = batch.column("__file").dictionary_encode()
            first = np.array([known.value[f] for f in file.dictionary.to_pylist()], np.int64)
            slot = permute(first[file.indices.to_numpy()] + batch.column("__row").to_numpy(), total, key)
            order = np.argsort(slot)
            shard = slot[order] // shard_rows
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            body = batch.column("ids").to_pylist()
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    own = order[lo:hi]
                    part = batch.take(pa.array(own))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([int(shard[lo])], pa.int32()), pa.array([slot[own] % shard_rows], pa.list_(pa.int32()))]
                        + [pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), part.column(c)) for c in names]
                        + [pa.array([pack(b"".join(body[i] for i in own.tolist()))], pa.binary())],
                        names=["shard", "slot", *names, "body"])

    def write(batches):
        import zstandard
        unpack = zstandard.ZstdDecompressor(dict_data=known_bytes(zstandard)).decompress
        back = codes.value[1]
        for table in runs(batches, "shard"):
            shard = int(table.column("shard")[0].as_py())
            base = shard * shard_rows
            image = np.zeros((min(shard_rows, total - base), sequence + 1), kind)
            for row in range(table.num_rows):
                slot = table.column("slot")[row].values.to_numpy()
                length = table.column("length")[row].values.to_numpy()
                flat = np.frombuffer(unpack(table.column("body")[row].as_py()), kind)
                flat = flat if wide else back[flat]
                image[slot, 0] = length
                at = np.repeat(slot, length)
                within = np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)
                image[at, within + 1] = flat
            _write(f"{folder}/shard-{shard:06d}.bin", image.tobytes())
            for row in range(table.num_rows):
                slot = pa.array(table.column("slot")[row].values.to_numpy() + np.int64(base))
                yield pa.RecordBatch.from_arrays(
                    [table.column(c)[row].values for c in names] + [slot], names=[*names, "slot"])
    fields = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long"
    lists = f"doc_id array<{id_type}>, piece array<int>, start array<long>, length array<long>, ids_crc32 array<long>"
    dealt = placed.mapInArrow(deal, f"shard int, slot array<int>, {lists}, body binary")
    ranged = dealt.repartitionById(max(1, -(-total // shard_rows)), F.col("shard")).sortWithinPartitions("shard")
    done = staged(ranged.mapInArrow(write, f"{fields}, slot long"), "slots")
    return done.withColumns({"shard": F.floor(F.col("slot") / shard_rows).cast("int"), "byte_offset": F.col("slot") % shard_rows * stride})


def read_slots(folder: str, first: int = 0, count: int | None = None):
    """Yield (slot, ids) in training order from any slot on: one sequential read per shard."""
    system, name = _filesystem(folder)
    with system.open_input_stream(f"{name}/manifest.json") as f:
        facts = json.loads(f.read())
    last = facts["sequences"] if count is None else min(facts["sequences"], first + count)
    while first < last:
        shard = first // facts["shard_rows"]
        stop = min(last, (shard + 1) * facts["shard_rows"])
        with system.open_input_file(f"{name}/shard-{shard:06d}.bin") as f:
            f.seek((first - shard * facts["shard_rows"]) * facts["stride"])
            for slot in range(first, stop):
                record = np.frombuffer(f.read(facts["stride"]), f"<u{facts['bytes_per_id']}")
                yield slot, record[1:1 + int(record[0])]
        first = stop
