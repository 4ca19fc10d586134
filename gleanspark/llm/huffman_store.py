"""Token ids of documents, stored with a canonical length-limited Huffman code.

Writing takes three jobs: encode every text (ids of 16 or 32 bits, kept in the shared folder), count all ids, then sort
by document and write blocks. The table of counts has a row per vocabulary entry, so it is bounded by the tokenizer;
package-merge on the driver turns it into code lengths of at most MAX_BITS.

File format: a directory with two Parquet tables.
- `code`: (id, length). Canonical: codes of one length are consecutive in order of id, shorter ones first.
- `blocks`: (shard, block, first, doc_id[], n_tokens[], every, bit_at[], payload). A shard is a range of documents, in
  ascending order; a block holds whole documents, BLOCK ids or the first document beyond that. `first` is the number of
  ids before the block in its shard. `payload` is the bit stream, most significant bit first; `bit_at` has the bit
  offset of every `every`-th id, so a block decodes alone, and inside it all those stretches decode side by side.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanspark.llm.common import fresh_path, shuffle_partitions, spool, table
from gleanspark.llm.wordcache import worker_cache

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
MAX_BITS = 18
BLOCK, EVERY = 1 << 18, 256
_BLOCK_SCHEMA = "shard int, block int, first long, doc_id array<long>, n_tokens array<long>, every int, bit_at array<long>, payload binary"
_PUNCTUATION = "".join(map(chr, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]))
PART, WORDS = 8 << 20, 400_000  # bytes of text read together; words a Python worker remembers, then it forgets all
_TOKENIZERS: dict = {}


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def runs_of(flat: np.ndarray, ends: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the runs of `flat` numbered in `which`, one after the other, and their sizes); run i ends before ends[i]."""
    size = np.diff(ends, prepend=0)[which]
    shift = ends[which] - np.cumsum(size)
    return flat[np.repeat(shift, size) + np.arange(size.sum())], size


class TextReader:
    """Ids of whole texts from a tokenizer, by way of their distinct words.

    The tokenizer collapses white space and never joins across it, so a text's ids are those of its white-space
    delimited words. Where it also cuts between a letter and ASCII punctuation that ends a word, stem and ending are
    looked up apart. Words of letters that its own first steps rewrite one by one go to its model as they rewrite them,
    many at a time. All of this is tried here; any other word passes through the tokenizer as a whole.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        mark = self.tokenizer.model.end_of_word_suffix if isinstance(self.tokenizer.model, models.BPE) else None
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values(), default=0) + 1, bool)  # ids that end a word
        self.closes[[i for t, i in vocabulary.items() if mark and t.endswith(mark)]] = True
        # Letters below the combining marks: none of them changes with its neighbours.
        found = {chr(c): self._rewritten(chr(c)) for c in range(0x250) if chr(c).isalpha()}
        found = {c: r for c, r in found.items() if mark and r and [self._full(c)] == self._direct([r])}
        some = "".join(found)
        whole = all([self._full(x)] == self._direct(["".join(map(found.__getitem__, x))]) for x in ("the", some, some[::-1], some[::3] + some[1::3]) if found.keys() >= set(x))
        self.letters = {ord(c): r for c, r in found.items()} if whole else {}
        ends = ["a", "zq", *(c for c in found if c > "\x7f")]
        ends = all(self._full(x + p) == self._full(x) + self._full(p) for x in ends[:2] for p in [*_PUNCTUATION, ".,!'", "'.", "%%%"]) and all(self._full(x + ".'") == self._full(x) + self._full(".'") for x in ends)
        self.cuts_after = pa.array([chr(c) for c in self.letters] if ends else [], pa.string())
        self.folds = all(self._full(x) == self._full(x.lower()) for x in ("ABCDEFGHIJKLM NOPQRSTUVWXYZ", "Ab'S", "A.B"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]

    def _full(self, word: str) -> list[int]:
        return self.tokenizer.encode(word, add_special_tokens=False).ids

    def _rewritten(self, word: str) -> str:
        normal = self.tokenizer.normalizer.normalize_str(word) if self.tokenizer.normalizer else word
        pieces = self.tokenizer.pre_tokenizer.pre_tokenize_str(normal) if self.tokenizer.pre_tokenizer else [(normal, (0, len(normal)))]
        return pieces[0][0] if len(pieces) == 1 and " " not in pieces[0][0] else ""

    def _direct(self, rewritten: list[str]) -> list[list[int]]:
        """Ids of words that the model takes as they are; none of them is empty or holds a space."""
        ids = self.model.encode_batch_fast([" ".join(rewritten)], add_special_tokens=False)[0].ids
        ends = (np.flatnonzero(self.closes[ids]) + 1).tolist()
        return [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    def _atoms(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of words that are looked up as a whole."""
        out: list = [()] * len(words)
        plain = pc.match_substring_regex(words, f"^[{''.join(map(chr, self.letters))}]+$").to_numpy(zero_copy_only=False) if self.letters else np.zeros(len(words), bool)
        for at in np.flatnonzero(~plain).tolist():
            out[at] = self._full(words[at].as_py())
        letters = np.flatnonzero(plain)
        for at in range(0, len(letters), 4096):
            part = letters[at : at + 4096]
            rewritten = " ".join(words.take(pa.array(part)).to_pylist()).translate(self.letters).split(" ")
            for i, ids in zip(part.tolist(), self._direct(rewritten), strict=True):
                out[i] = ids
        ends = np.cumsum(np.fromiter(map(len, out), np.int64, len(out)))
        return np.fromiter(chain.from_iterable(out), self.kind, int(ends[-1]) if len(ends) else 0), ends

    def _read(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends) of words; endings of punctuation are cut off first."""
        stems = pc.utf8_rtrim(words, _PUNCTUATION)
        apart = pc.and_(pc.not_equal(stems, words), pc.is_in(pc.utf8_slice_codeunits(stems, -1), self.cuts_after))
        for token in self.special:
            apart = pc.and_not(apart, pc.match_substring(words, token, ignore_case=True))
        stems = pc.if_else(apart, stems, words)
        tails = pc.if_else(apart, pc.replace_substring_regex(words, f"(?s)^.*[^{re.escape(_PUNCTUATION)}]", ""), "")
        atoms = pa.concat_arrays([stems, tails]).dictionary_encode()
        which = atoms.indices.to_numpy(zero_copy_only=False).reshape(2, -1).T.reshape(-1)
        ids, size = runs_of(*self._atoms(atoms.dictionary), which)
        return ids, np.cumsum(size.reshape(-1, 2).sum(1))

    def _numbers(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, ends, number of each of these distinct words among their runs); words new to this worker are read first."""
        memory = worker_cache(self)
        if not memory:
            memory.update(known=pa.array([], pa.string()), ids=np.empty(0, self.kind), ends=np.zeros(0, np.int64))
        at = pc.index_in(words, memory["known"])
        new = words.filter(at.is_null())
        if len(new):
            if len(memory["known"]) + len(new) > WORDS:
                new, memory["known"], memory["ids"], memory["ends"] = words, words[:0], memory["ids"][:0], memory["ends"][:0]
            ids, ends = self._read(new)
            memory["known"] = pa.concat_arrays([memory["known"], new])
            memory["ends"] = np.concatenate([memory["ends"], ends + len(memory["ids"])])
            memory["ids"] = np.concatenate([memory["ids"], ids])
            at = pc.index_in(words, memory["known"])
        return memory["ids"], memory["ends"], at.to_numpy(zero_copy_only=False)

    def read(self, texts: pa.Array, end: int | None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each), `end` closing each of them; a null text is read as empty."""
        texts = texts.fill_null("")
        low = pc.ascii_lower(texts) if self.folds else texts
        for token in self.special:  # special tokens are read as written
            low = pc.if_else(pc.match_substring(low, token.lower()), texts, low)
        lists = pc.ascii_split_whitespace(low)
        words = lists.flatten().dictionary_encode()
        ids, ends, number = self._numbers(words.dictionary)
        ids, size = runs_of(ids, ends, number[words.indices.to_numpy()])
        so_far = np.concatenate([[0], np.cumsum(size)])[lists.offsets.to_numpy() - lists.offsets[0].as_py()]
        n = np.diff(so_far)
        return (ids, n) if end is None else (np.insert(ids, so_far[1:], end), n + 1)


def reader(path: str) -> TextReader:
    """This worker's reader."""
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = TextReader(path)
    return _TOKENIZERS[path]


def text_ids(text: str, path: str, end: int | None = END_ID) -> list[int]:
    """Ids of one whole text, with the end id appended."""
    return reader(path).read(pa.array([text]), end)[0].tolist()


def encode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", end: int | None = END_ID) -> DataFrame:
    """(doc_id, ids, width): the ids of every text as binary, `width` bytes each; a null text is read as empty.

    One row per row of `docs`, repeated ones too; only these two columns of it are read, so other names don't matter. An
    empty table gives an empty one.
    """

    @F.arrow_udf("struct<ids:binary,width:int>")
    def of(texts: pa.Array) -> pa.Array:
        found = reader(path)
        size = np.cumsum(pc.binary_length(texts.fill_null("")).to_numpy(zero_copy_only=False).astype(np.int64)) // PART
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
        parts = [pa.array([], pa.binary())]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            ids, n = found.read(texts.slice(a, b - a), end)
            offsets = np.concatenate([[0], np.cumsum(n) * ids.itemsize]).astype(np.int32)
            parts.append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer(offsets), pa.py_buffer(ids)]))
        made = pa.concat_arrays(parts)
        return pa.StructArray.from_arrays([made, pa.array(np.full(len(made), int(found.kind[-1]), np.int32))], ["ids", "width"])

    made = docs.select(F.col(doc_id).cast("long").alias("doc_id"), of(F.col(text)).alias("t"))
    return made.select("doc_id", "t.ids", "t.width")


def flat_ids(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows of a batch, number of ids of each row) from columns ids and width."""
    width = batch.column("width").to_numpy(zero_copy_only=False)
    coded = batch.column("ids").to_pylist()
    sizes = np.fromiter(map(len, coded), np.int64, len(coded)) // np.maximum(width, 1)
    if len(np.unique(width)) <= 1:
        return np.frombuffer(b"".join(coded), f"<u{width[0] if len(width) else 4}"), sizes
    return np.concatenate([np.frombuffer(x, f"<u{w}").astype("<u4") for x, w in zip(coded, width, strict=True)]), sizes


def count_ids(encoded: DataFrame) -> DataFrame:
    """(id, n) over all documents, summed per task before the shuffle."""

    def count(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            n = np.bincount(flat_ids(batch)[0], minlength=len(total))
            n[: len(total)] += total
            total = n
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    return encoded.select("ids", "width").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code of at most `limit` bits for positive counts, by package-merge."""
    n = len(counts)
    if n <= 1:
        return np.ones(n, np.int64)
    limit = max(limit, int(np.ceil(np.log2(n))))
    order = np.argsort(counts, kind="stable")
    coins = counts[order].astype(np.int64)
    weights, levels = coins, []
    for _ in range(limit - 1):
        pairs = weights[: len(weights) // 2 * 2].reshape(-1, 2).sum(1)
        merged = np.concatenate([coins, pairs])
        at = np.argsort(merged, kind="stable")
        weights = merged[at]
        levels.append(at)
    take, lengths = 2 * n - 2, np.zeros(n, np.int64)
    for at in reversed(levels):
        chosen = at[:take]
        lengths[chosen[chosen < n]] += 1
        take = 2 * int((chosen >= n).sum())
    lengths[:take] += 1
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


def canonical(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order of code, codes) by length, then id."""
    order = np.lexsort((ids, lengths))
    widest = int(lengths.max(initial=1))
    steps = 1 << (widest - lengths[order])
    return order, (np.cumsum(steps) - steps) >> (widest - lengths[order])


class Code:
    """Encoder and decoder tables of a canonical code, given (id, length)."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.bits = int(lengths.max(initial=1))
        order, codes = canonical(ids, lengths)
        size = int(ids.max(initial=0)) + 1
        self.length, self.code = np.zeros(size, np.int64), np.zeros(size, np.uint64)
        self.length[ids[order]], self.code[ids[order]] = lengths[order], codes
        self.table = np.zeros(1 << self.bits, np.int32)  # the next `bits` bits -> id << 5 | length
        filled = np.repeat(ids[order] << 5 | lengths[order], 1 << (self.bits - lengths[order]))
        self.table[: len(filled)] = filled

    def encode(self, ids: np.ndarray, every: int = EVERY) -> tuple[bytes, np.ndarray]:
        """(bit stream, bit offset of every `every`-th id)."""
        n = self.length[ids]
        at = np.cumsum(n) - n
        total = int(n.sum())
        word, shift = at >> 5, (64 - n - (at & 31)).astype(np.uint64)
        v = self.code[ids] << shift
        size = (total >> 5) + 2
        high = np.bincount(word, (v >> np.uint64(32)).astype(np.float64), size)
        low = np.bincount(word + 1, (v & np.uint64(0xFFFFFFFF)).astype(np.float64), size + 1)[:size]
        return (high + low).astype(">u4").tobytes()[: (total + 7) // 8], at[::every]

    def decode(self, payload: bytes, bit_at: np.ndarray, n: int, every: int = EVERY) -> np.ndarray:
        """The `n` ids of a bit stream; stretches between offsets are decoded side by side, one id each a step."""
        b = np.frombuffer(payload + bytes(8), np.uint8).astype(np.int64)
        window = b[:-3] << 24 | b[1:-2] << 16 | b[2:-1] << 8 | b[3:]
        at, mask, top = bit_at.astype(np.int64).copy(), (1 << self.bits) - 1, 32 - self.bits
        out = np.empty((every, len(at)), np.int32)
        last = len(window) - 1
        for k in range(every):
            e = self.table[window[np.minimum(at >> 3, last)] >> (top - (at & 7)) & mask]
            out[k] = e >> 5
            at += e & 31
        return out.T.reshape(-1)[:n]


def write_ids(encoded: DataFrame, path: str, block: int = BLOCK, every: int = EVERY, max_bits: int = MAX_BITS) -> None:
    """Write (doc_id, ids, width) rows to a directory in the format above, in ascending order of doc_id.

    Null ids come first; rows that repeat an id are ordered by a hash of their ids. Documents of any length are stored
    whole, those without ids too. No rows: tables without rows. Only the three columns named are read.
    """
    spark = encoded.sparkSession
    counts = count_ids(encoded).toPandas().sort_values("id")
    ids = counts["id"].to_numpy(np.int64)
    lengths = code_lengths(counts["n"].to_numpy(np.int64), max_bits)
    spark.createDataFrame(list(zip(ids.tolist(), lengths.tolist(), strict=True)), "id long, length long").coalesce(1).write.parquet(f"{path}/code")
    sent = spark.sparkContext.broadcast((ids, lengths))  # a row per vocabulary entry

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*sent.value)
        shard, number, first = TaskContext.get().partitionId(), 0, 0
        docs: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, first, size
            payload, bit_at = code.encode(np.concatenate(held), every)
            row = [shard, number, first, docs[:], [len(h) for h in held], every, bit_at.tolist(), payload]
            first, number, size = first + size, number + 1, 0
            docs.clear()
            held.clear()
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.int64()), pa.binary())
            names = ("shard", "block", "first", "doc_id", "n_tokens", "every", "bit_at", "payload")
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names)

        for batch in batches:
            flat, sizes = flat_ids(batch)
            ends = np.cumsum(sizes)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), (ends - sizes).tolist(), ends.tolist(), strict=True):
                docs.append(doc)
                held.append(flat[a:b])
                size += b - a
                if size >= block:
                    yield flush()
        if docs:
            yield flush()

    keyed = encoded.select("doc_id", "ids", "width", F.xxhash64("ids").alias("h"))
    ordered = keyed.repartitionByRange(shuffle_partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h")
    ordered.drop("h").mapInArrow(blocks, _BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every stored document, decoded from the files, repeated and null ids too.

    A store without documents gives no rows. `start` counts the ids of all documents before; the crc covers the ids as little-endian unsigned 32-bit integers.
    """
    blocks = spark.read.schema(_BLOCK_SCHEMA).parquet(f"{path}/blocks")
    code = spark.read.schema("id long, length long").parquet(f"{path}/code").toPandas()  # a row per vocabulary entry
    sent = spark.sparkContext.broadcast((code["id"].to_numpy(np.int64), code["length"].to_numpy(np.int64)))
    sizes = blocks.groupBy("shard").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("size"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # a row per shard
    shards = sizes.select("shard", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*sent.value)
        for batch in batches:
            for row in batch.to_pylist():
                sizes = np.array(row["n_tokens"], np.int64)
                ends = np.cumsum(sizes)
                ids = code.decode(row["payload"], np.array(row["bit_at"]), int(ends[-1]), row["every"]).astype("<u4")
                crc = [zlib.crc32(ids[b - n : b].tobytes()) for b, n in zip(ends, sizes, strict=True)]
                starts = row["first"] + ends - sizes
                yield pa.RecordBatch.from_arrays([pa.array([row["shard"]] * len(crc), pa.int32()), pa.array(row["doc_id"], pa.int64()), pa.array(starts), pa.array(sizes), pa.array(crc, pa.int64())], ["shard", "doc_id", "start", "n_tokens", "ids_crc32"])

    found = blocks.mapInArrow(unpack, "shard int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return found.join(shards, "shard").select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents, write their ids to the shared folder, and describe what the files hold; odd rows as in `encode`."""
    path = fresh_path(spark, "token-store")
    write_ids(spool(encode(table(spark, sf_dir, "documents"), tokenizer_path()), "token-ids"), path)
    return read_ids(spark, path)


QUERIES = {"op8_token_store": op8_token_store}
ORACLE: dict[str, str] = {}
