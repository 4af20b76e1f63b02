"""Token-ID / binary output: canonical length-limited Huffman coding of token ids (operator 9).

File format (little-endian). A file holds one run of documents:

    magic b"HTK1", 5 x uint64: documents, ids, end id, bits, checkpoint distance,
    int64 doc_id and uint32 length of each document, uint8 that is 1 where doc_id is null,
    uint64 bit offset of every ``distance``-th id, the code bits (first bit highest),
    4 zero bytes, newline.

The code table is a file of its own: magic b"HTKC", uint32 number of ids, one uint8 code
length per id (0: not used), newline. Codes are canonical: by length, then id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from embertide.llm.bpe import byte_characters
from embertide.llm.common import LANE, Stage, arrow_map, columns_of, new_folder, pieces, text_buffer
from embertide.llm.files import read_files, write_files
from embertide.llm.spans import SpanMemory, one_piece, text_ids

LONGEST = 16  # bits of a code, or as many more as it takes to give each used id one
MOST_BITS = 24  # a code and its place in a byte fit 32 bits
DISTANCE = 256  # ids between checkpoints; all checkpoints of a file decode side by side
RUN_IDS = 3_000_000  # ids of one file; a longer document has a file of its own
END_ID = 2
TEXT_BYTES = 500_000  # text whose spans are cut and looked up at a time: numbers a byte that stay in the cache
PACKED = 1 << 16  # ids that are packed at a time
STRUNG = 500  # spans that are handed to the tokenizer as one text


# --- tokenizing ------------------------------------------------------------------------


class SpanTokenizer:
    """Ids of distinct spans by the tokenizer library.

    Spans that the splitting pattern takes as one piece go to the library's model as they are, where the file has
    no rules of its own. Others are strung together with a special token between them, which parts them for the
    tokenizer like separate texts. With ``special_as_text`` a special token's name in a text is ordinary text.
    """

    def __init__(self, tokenizer, special_as_text: bool = False):
        self.tokenizer, self.special_as_text = tokenizer, special_as_text
        special = sorted(
            (i, t.content) for i, t in tokenizer.get_added_tokens_decoder().items() if t.special)
        self.number, self.name = (special[0][0], special[0][1].encode()) if special else (None, None)
        # the name of one special token is cut out as a span of its own; more of them leave texts whole
        self.mark = None if special_as_text or len(special) != 1 else self.name
        self.whole = len(special) > 1 and not special_as_text
        self.characters = self._characters(len(special))

    def _characters(self, n_special: int) -> np.ndarray | None:
        """The character that stands for each byte in the model's texts; null if pieces cannot go to the model alone."""
        from tokenizers import models, pre_tokenizers

        split = self.tokenizer.pre_tokenizer
        names = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        plain = (
            isinstance(split, pre_tokenizers.ByteLevel) and split.use_regex and not split.add_prefix_space
            and isinstance(self.tokenizer.model, models.BPE) and not self.tokenizer.model.dropout
            and self.tokenizer.normalizer is None and not self.tokenizer.truncation and not self.tokenizer.padding
            and len(names) == n_special <= 1
            and not any(one_piece(np.frombuffer(n, np.uint8), np.array([0, len(n)])).any() for n in names))
        if not plain:
            return None
        found = np.zeros(256, "<u2")
        for character, byte in byte_characters().items():
            found[byte] = ord(character)
        return found

    def __call__(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        if self.characters is None:
            return self.strung(spans)
        raw = np.frombuffer(b"".join(spans), np.uint8)
        bounds = np.concatenate([[0], np.cumsum([len(s) for s in spans])]).astype(np.int64)
        alone = one_piece(raw, bounds)
        text, tokenize = self.characters[raw].tobytes().decode("utf-16-le"), self.tokenizer.model.tokenize
        lists = [[t.id for t in tokenize(text[a:b])]
                 for a, b in zip(bounds[:-1][alone].tolist(), bounds[1:][alone].tolist())]
        counts = np.zeros(len(spans), np.int64)
        counts[alone] = [len(x) for x in lists]
        ids = np.array([i for x in lists for i in x], np.uint32)
        if alone.all():
            return ids, counts
        other, counts[~alone] = self.strung([s for s, a in zip(spans, alone.tolist()) if not a])
        own, out = np.repeat(alone, counts), np.zeros(int(counts.sum()), np.uint32)
        out[own], out[~own] = ids, other
        return out, counts

    def strung(self, spans: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        alone = self.name is None or self.whole or (
            self.name in b"".join(spans) and any(self.name in s for s in spans))
        if alone:
            self.tokenizer.encode_special_tokens = self.special_as_text
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(
                [s.decode() for s in spans], add_special_tokens=False)]
            return (np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists], np.int64))
        self.tokenizer.encode_special_tokens = False
        strung = [(self.name.join(spans[k:k + STRUNG]) + self.name).decode() for k in range(0, len(spans), STRUNG)]
        ids = np.concatenate([
            np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(strung, add_special_tokens=False)])
        marks = ids == self.number
        ends = np.flatnonzero(marks) - np.arange(len(spans))
        return ids[~marks], np.diff(ends, prepend=0)


def encoded(batches, tokenizer, end_id: int, special_as_text: bool = False) -> Iterator[tuple]:
    """(doc ids, document lengths, ids) of each piece of the batches, end ids appended."""
    encode = SpanTokenizer(tokenizer, special_as_text)
    memory = SpanMemory(encode)
    for batch in pieces(batches, limit=TEXT_BYTES):
        raw, bounds = text_buffer(batch.column(1))
        if encode.whole:
            data = raw.tobytes()
            ids, lengths = encode([data[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())])
        else:
            ids, lengths = text_ids(raw, bounds, memory, encode.mark)
        yield batch.column(0), lengths + 1, np.insert(ids, np.cumsum(lengths), end_id)


# --- codes -----------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 for unused ids.

    With more used ids than codes of that length, the limit is the length that has room for all.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) == 1:
        lengths[used] = 1
        return lengths
    longest = max(longest, (len(used) - 1).bit_length()) if len(used) else longest
    if longest > MOST_BITS:
        raise ValueError(f"{len(used)} ids do not fit codes of {MOST_BITS} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    # per level: which sorted entries are leaves; pairs of a level make the packages of the next
    packages, levels = np.zeros(0, np.int64), []
    for _ in range(longest):
        weights = np.concatenate([leaves, packages])
        rank = np.argsort(weights, kind="stable")
        levels.append(rank < len(leaves))
        merged = weights[rank]
        packages = merged[:len(merged) // 2 * 2].reshape(-1, 2).sum(axis=1)
    taken = 2 * len(leaves) - 2
    for is_leaf in reversed(levels):
        n = int(is_leaf[:taken].sum())
        lengths[order[:n]] += 1
        taken = 2 * (taken - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Code of each id: by length, then id."""
    codes = np.zeros(len(lengths), np.uint32)
    code = previous = 0
    used = np.flatnonzero(lengths)
    for i in used[np.lexsort((used, lengths[used]))]:
        code <<= int(lengths[i]) - previous
        previous = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for every value of the next bits, and how many bits these are."""
    longest = max(int(lengths.max(initial=0)), 1)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = (1 << (longest - lengths[order].astype(np.int64)))
    symbols, bits = np.zeros(1 << longest, np.uint32), np.zeros(1 << longest, np.uint8)
    filled = int(spans.sum())
    symbols[:filled] = np.repeat(order, spans)
    bits[:filled] = np.repeat(lengths[order], spans)
    return symbols, bits, longest


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray, distance: int = DISTANCE):
    """Code bits of ``ids`` and the bit offset of every ``distance``-th id."""
    sizes = lengths.astype(np.int64)
    words = np.zeros(len(ids) * int(sizes.max(initial=0)) // 32 + 4, np.uint32)
    offsets, total = [np.zeros(0, np.int64)], 0
    for low in range(0, len(ids), PACKED):
        part = ids[low:low + PACKED]
        width, value = sizes[part], codes[part].astype(np.uint64)
        if not width.all():
            raise ValueError("an id without a code")
        at = total + np.cumsum(width) - width
        offsets.append(at[-low % distance::distance])
        total += int(width.sum())
        if len(part) % 2:
            width, value = np.append(width, 0), np.append(value, np.uint64(0))
        value = (value[::2] << width[1::2].astype(np.uint64)) | value[1::2]  # two codes, 48 bits at most
        at, end = at[::2], at[::2] + width[::2] + width[1::2]
        first = int(at[0]) >> 5
        word = (at >> 5) - first
        for k in range(int((((end - 1) >> 5) - (at >> 5)).max()) + 1):  # bits never overlap, so sums are ors
            shift = 32 * ((at >> 5) + k + 1) - end
            bits = np.where(shift >= 0, value << np.maximum(shift, 0).astype(np.uint64),
                            value >> np.maximum(-shift, 0).astype(np.uint64)) & np.uint64(0xFFFFFFFF)
            added = np.bincount(word + k, weights=bits.astype(np.float64)).astype(np.uint32)
            words[first:first + len(added)] |= added
    bits = words[:total // 32 + 4].astype(">u4").view(np.uint8)[:total // 8 + 5]
    return bits, np.concatenate(offsets).astype(np.uint64), total


def unpack(bits: np.ndarray, offsets: np.ndarray, n: int, table, distance: int = DISTANCE) -> np.ndarray:
    """The ``n`` ids; every checkpoint's stretch is decoded on its own, all of them in step."""
    symbols, widths, longest = table
    data = np.concatenate([bits, np.zeros(7, np.uint8)])
    following = np.zeros(len(data) - 3, np.uint32)  # the 32 bits from each byte on
    for k in range(4):
        following |= data[k:len(following) + k].astype(np.uint32) << np.uint32(24 - 8 * k)
    ids = np.zeros((distance, len(offsets)), np.uint32)
    at, last, unused = offsets.astype(np.int64), len(following) - 1, np.uint32(32 - longest)
    for step in range(min(distance, n)):
        window = (following[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> unused
        ids[step] = symbols[window]
        at += widths[window]
    return ids.T.reshape(-1)[:n]


# --- files -----------------------------------------------------------------------------

MAGIC, TABLE_MAGIC = b"HTK1", b"HTKC"


def run_bytes(doc_ids, nulls, lengths, ids, code, end_id: int, distance: int = DISTANCE) -> bytes:
    bits, offsets, total = pack(ids, *code, distance)
    head = np.array([len(lengths), len(ids), end_id, total, distance], "<u8")
    return b"".join([
        MAGIC, head.tobytes(), doc_ids.astype("<i8").tobytes(), lengths.astype("<u4").tobytes(),
        nulls.astype(np.uint8).tobytes(), offsets.astype("<u8").tobytes(), bits.tobytes(), b"\0\0\0\0\n"])


def run_parts(content: bytes, table) -> tuple:
    """(doc ids, null marks, lengths, ids) of one file."""
    if content[:4] != MAGIC:
        raise ValueError("not a token file")
    docs, n, _, total, distance = (int(x) for x in np.frombuffer(content, "<u8", 5, 4))
    at = 44
    doc_ids = np.frombuffer(content, "<i8", docs, at)
    at += 8 * docs
    lengths = np.frombuffer(content, "<u4", docs, at).astype(np.int64)
    at += 4 * docs
    nulls = np.frombuffer(content, np.uint8, docs, at).astype(bool)
    at += docs
    stops = -(-n // distance)
    offsets = np.frombuffer(content, "<u8", stops, at)
    at += 8 * stops
    bits = np.frombuffer(content, np.uint8, total // 8 + 5, at)
    return doc_ids, nulls, lengths, unpack(bits, offsets, n, table, distance)


def table_bytes(lengths: np.ndarray) -> bytes:
    return TABLE_MAGIC + np.array([len(lengths)], "<u4").tobytes() + lengths.tobytes() + b"\n"


def table_lengths(content: bytes) -> np.ndarray:
    if content[:4] != TABLE_MAGIC:
        raise ValueError("not a code table")
    return np.frombuffer(content, np.uint8, int(np.frombuffer(content, "<u4", 1, 4)[0]), 8)


RUN_SCHEMA = "part int, seq long, doc_ids binary, nulls binary, lengths binary, ids binary, n_ids long"


def token_runs(
    docs: DataFrame, stage: Stage, tokenizer_path: str, doc_id: str, text: str, end_id: int, special_as_text: bool = False,
) -> DataFrame:
    """Documents in ascending doc_id order as staged runs of ids: part, seq, and packed columns."""
    rows = columns_of(docs, ("doc_id", F.col(doc_id)), ("text", F.col(text)))
    ordered = rows.repartitionByRange(F.col("doc_id"), F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"))
    ordered = ordered.withColumn("part", F.shiftright(F.monotonically_increasing_id(), LANE).cast("int"))

    def kernel(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task per core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(tokenizer_path)
        part, seq, held, size = [0], 0, [], 0

        def noted():
            for batch in batches:
                if batch.num_rows:
                    part[0] = batch.column(2)[0].as_py()
                    yield batch

        def closed():
            keys = pa.chunked_array([k for k, _, _ in held]).combine_chunks()
            return pa.RecordBatch.from_arrays([
                pa.array([part[0]], pa.int32()), pa.array([seq], pa.int64()),
                pa.array([keys.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()], pa.binary()),
                pa.array([np.asarray(keys.is_null()).astype(np.uint8).tobytes()], pa.binary()),
                pa.array([np.concatenate([n for _, n, _ in held]).astype("<u4").tobytes()], pa.binary()),
                pa.array([np.concatenate([i for _, _, i in held]).astype(kind).tobytes()], pa.binary()),
                pa.array([size], pa.int64()),
            ], ["part", "seq", "doc_ids", "nulls", "lengths", "ids", "n_ids"])

        kind = "<u2" if tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else "<u4"
        for keys, lengths, ids in encoded(noted(), tokenizer, end_id, special_as_text):
            held.append((keys, lengths, ids))
            size += len(ids)
            if size >= RUN_IDS:
                yield closed()
                held, size, seq = [], 0, seq + 1
        if held:
            yield closed()

    return stage.put(arrow_map(ordered, kernel, RUN_SCHEMA), "runs")


def ids_of(run: dict) -> np.ndarray:
    n = run["n_ids"]
    return np.frombuffer(run["ids"], "<u2" if len(run["ids"]) == 2 * n else "<u4")


def global_counts(runs: DataFrame, vocabulary: int) -> np.ndarray:
    """How often each id occurs in all runs; tasks count first, so one row per id and task moves."""
    def kernel(batches):
        counts = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for run in batch.to_pylist():
                counts += np.bincount(ids_of(run), minlength=vocabulary)
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(counts[used])], ["id", "n"])

    sums = arrow_map(runs.select("ids", "n_ids"), kernel, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))
    counts = np.zeros(vocabulary, np.int64)
    for r in sums.collect():  # at most one row per id of the vocabulary
        counts[r["id"]] = r["n"]
    return counts


def write_tokens(
    docs: DataFrame, path: str, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    special_as_text: bool = False,
) -> None:
    """Tokenize documents and write them below ``path`` in ascending doc_id order.

    Texts are sorted by range partitioning before they are tokenized, so each is tokenized
    once; the ids wait in a staged table until the code is known. Null texts are empty: only
    the end id. Documents of equal doc_id stand in the order of their texts' hashes; null
    doc_ids come first. The name of a special token in a text is that token, as in the library's
    default call, unless ``special_as_text``.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    stage = Stage(spark)
    runs = token_runs(docs, stage, tokenizer_path, doc_id, text, end_id, special_as_text)
    vocabulary = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id + 1)
    lengths = code_lengths(global_counts(runs, vocabulary))
    codes = canonical(lengths)

    def kernel(batches):
        for batch in batches:
            for run in batch.to_pylist():
                content = run_bytes(
                    np.frombuffer(run["doc_ids"], "<i8"), np.frombuffer(run["nulls"], np.uint8),
                    np.frombuffer(run["lengths"], "<u4"), ids_of(run), (lengths, codes), end_id)
                yield pa.RecordBatch.from_pydict(
                    {"name": [f"run-{run['part']:08d}-{run['seq']:08d}"], "content": [content]})

    write_files(arrow_map(runs, kernel, "name string, content binary"), f"{path}/runs")
    write_files(spark.createDataFrame([("table", table_bytes(lengths))], "name string, content binary"),
                f"{path}/code")
    stage.drop("runs")


TOKEN_SCHEMA = "name string, row int, doc_id long, n_tokens long, ids binary, ids_crc32 long"


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """Documents of the token files below ``path``: file name, row in the file, doc_id, n_tokens,
    ids (little-endian unsigned 32-bit; null unless ``with_ids``), ids_crc32, start (ids before it)."""
    found = read_files(spark, f"{path}/code").collect()  # one table of a byte per id
    table = decode_table(table_lengths(bytes(found[0]["content"])))

    def kernel(batches):
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                doc_ids, nulls, lengths, ids = run_parts(content.as_py(), table)
                ids = ids.astype("<u4")
                ends = np.cumsum(lengths)
                view = memoryview(ids.tobytes())
                blobs = [view[4 * (e - n):4 * e] for e, n in zip(ends.tolist(), lengths.tolist())]
                for low in range(0, len(blobs), 2000):
                    part = slice(low, low + 2000)
                    n = len(blobs[part])
                    yield pa.RecordBatch.from_arrays([
                        pa.array([name] * n), pa.array(np.arange(low, low + n, dtype=np.int32)),
                        pa.array(doc_ids[part], pa.int64(), mask=nulls[part]), pa.array(lengths[part]),
                        pa.array([bytes(b) if with_ids else None for b in blobs[part]], pa.binary()),
                        pa.array([zlib.crc32(b) for b in blobs[part]], pa.int64()),
                    ], ["name", "row", "doc_id", "n_tokens", "ids", "ids_crc32"])

    return arrow_map(read_files(spark, f"{path}/runs"), kernel, TOKEN_SCHEMA)


def starts_of(tokens: DataFrame, stage: Stage) -> DataFrame:
    """Add ``start``, the number of ids in all documents before: files' totals are summed, not documents."""
    held = stage.put(tokens, "tokens")
    part = F.substring("name", 1, 12)
    files = held.groupBy("name").agg(F.sum("n_tokens").alias("_ids")).withColumn("_part", part)
    parts = files.groupBy("_part").agg(F.sum("_ids").alias("_all"))
    up_to = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per writing task
    parts = parts.withColumn("_parts_before", F.coalesce(F.sum("_all").over(up_to), F.lit(0))).drop("_all")
    inside = Window.partitionBy("_part").orderBy("name").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("_files_before", F.coalesce(F.sum("_ids").over(inside), F.lit(0))).drop("_ids")
    files = files.join(parts, "_part").select(
        "name", (F.col("_parts_before") + F.col("_files_before")).alias("_before"))
    rows = Window.partitionBy("name").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    return held.join(files, "name").withColumn(
        "start", F.col("_before") + F.coalesce(F.sum("n_tokens").over(rows), F.lit(0))).drop("_before")


def token_output(
    docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID,
    path: str | None = None, special_as_text: bool = False,
) -> DataFrame:
    """Write documents as token files (below ``path``, or a scratch folder) and read them back.

    Per input row, from the files: doc_id, start (ids of all documents before it), n_tokens
    (with the end id), ids_crc32 (of its ids as little-endian unsigned 32-bit integers).
    An empty table gives no rows and no files.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    if docs.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    write_tokens(docs, path, tokenizer_path, doc_id, text, end_id, special_as_text)
    tokens = read_tokens(spark, path, with_ids=False).select("name", "row", "doc_id", "n_tokens", "ids_crc32")
    return starts_of(tokens, Stage(spark)).select("doc_id", "start", "n_tokens", "ids_crc32")
