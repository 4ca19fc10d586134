"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces.

The pieces come from a SentencePiece model file, whose path is a parameter, and their log scores from the scores in it
(see log_scores); nothing is trained.
A text is escaped (spaces become the marker U+2581, one is put in front), then cut into the pieces of the largest total
score; of equal totals the path whose last pieces start earliest wins, at every position. A character that no piece
covers costs UNKNOWN less than the lowest score and is written as byte pieces. Decoding joins pieces, turns byte pieces
back into bytes, markers into spaces, and takes away the one in front.

No piece has a marker after another character, and some characters are in no piece of several characters, so a best
path always breaks there: units between such breaks are encoded alone and remembered per worker.
"""

from __future__ import annotations

import math
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.llm.common import free_prefix, quoted, table
from gleanspark.llm.wordcache import worker_cache

MODEL = "piece_bpe_32k.model"
MARKER = "▁"
UNKNOWN = 10.0  # fixed value: the penalty of an uncovered character
NORMAL, BYTE = 1, 6  # fixed values: kinds of pieces
WORDS = 200_000  # words a Python worker remembers; then it forgets all
TEXTS_AT_ONCE, MANY, LONG = 400, 4096, 64  # texts and units that are encoded side by side; bytes beyond which a unit is not
MADE = ("ids", "log_score", "n_bytes", "round_trip")


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def log_scores(scores: list[float], kinds: list[int]) -> list[float]:
    """Log scores of pieces. A unigram file has them; a merge file has minus the merge's rank instead (whole numbers).

    Ranks go by frequency, so Zipf's law gives the log score: -ln(rank + 2), less the log of the sum over all ranks.
    Pieces that stand outside the ranks (below -1e8) count as the last rank.
    """
    normal = [s for s, k in zip(scores, kinds, strict=True) if k == NORMAL]
    if any(s != int(s) for s in normal):
        return scores
    last = max((-s for s in normal if s > -1e8), default=0.0) + 1
    whole = math.log(sum(1 / (min(-s, last) + 2) for s in normal)) if normal else 0.0
    return [-math.log(min(-s, last) + 2) - whole if k == NORMAL else 0.0 for s, k in zip(scores, kinds, strict=True)]


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, log score, kind) by id, from the library's reader."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    other = lambda i: 2 if sp.is_unknown(i) else 3 if sp.is_control(i) else 5 if sp.is_unused(i) else NORMAL
    kinds = [BYTE if sp.is_byte(i) else other(i) for i in range(sp.get_piece_size())]
    scores = log_scores([sp.get_score(i) for i in range(len(kinds))], kinds)
    return [(sp.id_to_piece(i), s, k) for i, (s, k) in enumerate(zip(scores, kinds, strict=True))]


class DoubleArray:
    """Trie over UTF-8 bytes in two arrays: from state s byte b leads to t = base[s] + b + 1 if check[t] == s.

    `value[s]` is the id of the piece that ends in s, or -1.
    """

    def __init__(self, words: dict[bytes, int]):
        tree: dict = {}
        for word, n in words.items():
            at = tree
            for b in word:
                at = at.setdefault(b, {})
            at[-1] = n
        size = 1 << 12
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0], start, queue = 0, 1, [(0, tree)]
        for s, node in queue:
            value[s] = node.pop(-1, -1)
            if not node:
                continue
            labels = sorted(node)
            first, used, pos, seen = labels[0] + 1, 0, max(labels[0] + 1, start), False
            while True:  # pos: where the first child goes
                need = pos - first + labels[-1] + 2
                if need > len(check):
                    more = max(need - len(check), len(check))
                    base, check, value = base + [0] * more, check + [-1] * more, value + [-1] * more
                if check[pos] >= 0:
                    used += 1
                else:
                    if not seen:
                        start, seen = pos, True
                    if all(check[pos - first + b + 1] < 0 for b in labels):
                        break
                pos += 1
            if used >= 0.95 * (pos - start + 1):
                start = pos  # nearly full up to here
            base[s] = pos - first
            for b in labels:
                check[pos - first + b + 1] = s
                queue.append((pos - first + b + 1, node[b]))
        spare = 257  # so that any byte from any state stays inside
        self.base, self.check, self.value = (np.array(a + [f] * spare, np.int32) for a, f in ((base, 0), (check, -1), (value, -1)))


class Pieces:
    """A piece table with its trie, encoder and decoder."""

    def __init__(self, pieces: list[tuple[str, float, int]]):
        self.names = [p for p, _, _ in pieces]
        self.scores = [s for _, s, _ in pieces]
        normal = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown_id = next((i for i, (_, _, k) in enumerate(pieces) if k == 2), 0)
        self.trie = DoubleArray({p.encode(): i for p, i in normal.items()})
        self.penalty = min((self.scores[i] for i in normal.values()), default=0.0) - UNKNOWN
        self.bytes_of = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARKER, " ").encode() if k == NORMAL else b"" for p, _, k in pieces]
        joined = {c for p in normal for c in p if len(p) > 1}
        inner = any(MARKER in p.lstrip(MARKER) for p in normal)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in joined)
        word = f"[^{MARKER}{alone}]"
        self.unit = re.compile(r"(?s).+" if inner else (f"[{alone}]|" if alone else "") + f"{MARKER}+{word}*|{word}+")
        self.score_of = np.array(self.scores)
        for b, i in self.byte_ids.items():
            self.score_of[i] = 0.0 if 0x80 <= b < 0xC0 else self.penalty  # once a character, not once a byte
        self.score_of[self.unknown_id] = self.penalty
        self.is_byte = np.zeros(len(pieces), bool)
        self.is_byte[list(self.byte_ids.values())] = True
        self._lists = [a.tolist() for a in (self.trie.base, self.trie.check, self.trie.value)]

    def viterbi(self, text: bytes) -> tuple[list[int], float]:
        """(ids, total score) of the best path; an uncovered character takes its byte pieces, or the unknown id."""
        (base, check, value), scores = self._lists, self.scores
        n, top = len(text), len(check)
        best, start, came = [None] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        i = 0
        while i < n:
            lead = text[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, s, single = best[i], 0, False
            for j in range(i, n):
                t = base[s] + text[j] + 1
                if t >= top or check[t] != s:
                    break
                s = t
                v = value[s]
                if v >= 0:
                    total = here + scores[v]
                    if best[j + 1] is None or total > best[j + 1]:
                        best[j + 1], start[j + 1], came[j + 1] = total, i, v
                    single = single or j + 1 == i + width
            if not single:
                end, total = i + width, here + self.penalty
                if best[end] is None or total > best[end]:
                    best[end], start[end], came[end] = total, i, -1
            i += width
        out: list[int] = []
        at = n
        while at:
            if came[at] >= 0:
                out.append(came[at])
            elif self.byte_ids:
                out.extend(self.byte_ids[b] for b in reversed(text[start[at] : at]))
            else:
                out.append(self.unknown_id)
            at = start[at]
        return out[::-1], best[n]

    def viterbi_many(self, units: list[str]) -> list[bytes]:
        """Ids (little-endian 32-bit integers) of the best path of each unit: the same walk, side by side by length."""
        out: list[bytes] = [b""] * len(units)
        coded = [u.encode() for u in units]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        for n in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == n)
            for at in range(0, len(rows), MANY):
                part = rows[at : at + MANY].tolist()
                if n > LONG:
                    found = [np.array(self.viterbi(coded[r])[0], "<i4").tobytes() for r in part]
                else:
                    found = self._side_by_side([coded[r] for r in part], n)
                for r, ids in zip(part, found, strict=True):
                    out[r] = ids
        return out

    def _side_by_side(self, coded: list[bytes], n: int) -> list[bytes]:
        base, check, value = self.trie.base, self.trie.check, self.trie.value
        scores, k = np.array(self.scores), len(coded)
        text = np.frombuffer(b"".join(coded), np.uint8).reshape(k, n).T.astype(np.int32)
        width = np.select([text < 0x80, text < 0xE0, text < 0xF0], [1, 2, 3], 4)
        best = np.full((n + 1, k), -np.inf)
        start, came = np.zeros((n + 1, k), np.int32), np.full((n + 1, k), -1, np.int32)
        best[0] = 0.0
        for i in range(n):
            begin = np.flatnonzero((text[i] & 0xC0) != 0x80)
            single = np.zeros(k, bool)
            rows, s = begin, np.zeros(len(begin), np.int32)
            for j in range(i, n):
                t = base[s] + text[j, rows] + 1
                ok = check[t] == s
                rows, s = rows[ok], t[ok]
                if not len(rows):
                    break
                v = value[s]
                ends = v >= 0
                r, v = rows[ends], v[ends]
                total = best[i, r] + scores[v]
                better = total > best[j + 1, r]
                r_, v = r[better], v[better]
                best[j + 1, r_], start[j + 1, r_], came[j + 1, r_] = total[better], i, v
                single[r[width[i, r] == j + 1 - i]] = True
            rest = begin[~single[begin]]
            if len(rest):
                end, total = i + width[i, rest], best[i, rest] + self.penalty
                better = total > best[end, rest]
                rest, end = rest[better], end[better]
                best[end, rest], start[end, rest], came[end, rest] = total[better], i, -1
        each, at, steps, plain = np.arange(k), np.full(k, n), [], np.ones(k, bool)
        while (at > 0).any():
            ids = np.where(at > 0, came[at, each], -2)
            plain &= ids != -1
            steps.append(ids)
            at = np.where(at > 0, start[at, each], 0)
        path = np.array(steps[::-1], "<i4").T
        used = path >= 0
        flat, ends = path[used].astype("<i4").tobytes(), np.cumsum(used.sum(1)) * 4
        found = [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]
        for r in np.flatnonzero(~plain).tolist():  # byte pieces
            found[r] = np.array(self.viterbi(coded[r])[0], "<i4").tobytes()
        return found

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; nothing for an empty text."""
        out: list[bytes] = []
        cache = worker_cache(self)  # ids of words that follow one marker
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            part = texts[at : at + TEXTS_AT_ONCE]
            plain = [MARKER not in t and "  " not in t and not t.startswith(" ") for t in part]
            units = [([] if not t else t.split(" ") if p else self.unit.findall(MARKER + t.replace(" ", MARKER))) for t, p in zip(part, plain, strict=True)]
            new = set().union(*(u for u, p in zip(units, plain, strict=True) if p)).difference(cache)
            if len(cache) + len(new) > WORDS:
                cache.clear()
                new = set().union(*(u for u, p in zip(units, plain, strict=True) if p))
            atoms = {w: self.unit.findall(MARKER + w) for w in new}
            need = list(set().union(*atoms.values(), *(u for u, p in zip(units, plain, strict=True) if not p)))
            known = dict(zip(need, self.viterbi_many(need), strict=True))
            cache.update((w, b"".join(map(known.__getitem__, a))) for w, a in atoms.items())
            out += [b"".join(map((cache if p else known).__getitem__, u)) for u, p in zip(units, plain, strict=True)]
        return out

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], "<i4").tolist()

    def decode(self, ids) -> str:
        """The text of a list of ids; bytes that are no valid UTF-8 become U+FFFD."""
        text = b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


@lru_cache(4)
def load(path: str) -> Pieces:
    return Pieces(read_pieces(path))


def encode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """`docs` with ids (array of int), log_score, n_bytes (ids that are byte pieces) and round_trip (they decode to the text).

    A null text is read as empty, which has no ids; long texts are read whole. Every row is kept, repeated ones too, with
    its columns of any name; those of the four names are replaced. Equal totals are decided as the module says. An empty
    table gives an empty one.
    """

    @F.arrow_udf("struct<ids:array<int>,log_score:double,n_bytes:int,round_trip:boolean>")
    def of(texts: pa.Array) -> pa.Array:
        pieces = load(path)
        done = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):  # small parts, so that a worker's memory doesn't follow the batch
            given = [t or "" for t in texts.slice(at, TEXTS_AT_ONCE).to_pylist()]
            made = pieces.encode_many(given)
            flat = np.frombuffer(b"".join(made), "<i4")
            ends = np.cumsum([0] + [len(a) // 4 for a in made])
            so_far = lambda values, flat=flat: np.concatenate([[0], np.cumsum(values[flat])])
            score, n_bytes = so_far(pieces.score_of), so_far(pieces.is_byte.astype(np.int32))
            same = [pieces.decode(np.frombuffer(a, "<i4").tolist()) == t for a, t in zip(made, given, strict=True)]
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
            parts = [ids, pa.array(score[ends[1:]] - score[ends[:-1]]), pa.array(n_bytes[ends[1:]] - n_bytes[ends[:-1]], pa.int32()), pa.array(same, pa.bool_())]
            done.append(pa.StructArray.from_arrays(parts, list(MADE)))
        kind = pa.struct([("ids", pa.list_(pa.int32())), ("log_score", pa.float64()), ("n_bytes", pa.int32()), ("round_trip", pa.bool_())])
        return pa.concat_arrays(done) if done else pa.array([], kind)

    name = f"{free_prefix(docs)}made"
    made = docs.withColumn(name, of(quoted(text)))
    return made.withColumns({c: F.col(f"{name}.{c}") for c in MADE}).drop(name)


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`docs` with the text of an array of ids, in a column `out`, replaced if there is one.

    Null or no ids give an empty text, however many ids are read whole. Every row is kept, repeated ones too, with its
    other columns of any name. An empty table gives an empty one.
    """

    @F.arrow_udf("string")
    def of(lists: pa.Array) -> pa.Array:
        pieces = load(path)
        return pa.array([pieces.decode(x.values.to_numpy().tolist() if x.is_valid else []) for x in lists], pa.string())

    return docs.withColumn(out, of(quoted(ids)))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text of `documents`, and whether decoding them gives the text back; odd rows as in `encode`."""
    made = encode(table(spark, sf_dir, "documents").select("doc_id", "text"), model_path())
    return made.select("doc_id", "ids", F.size("ids").cast("long").alias("n_ids"), "n_bytes", "log_score", "round_trip")


QUERIES = {"op4_sentencepiece": op4_sentencepiece}
ORACLE: dict[str, str] = {}
