"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space marks.

A text gets the marks the format wants: a space in front, each space as U+2581. Of all ways to cut it into pieces the
one with the highest sum of log scores is taken; a character that no piece begins with alone costs UNKNOWN more than the
worst piece and is written as its bytes' pieces. No piece has a mark behind another character, and none has a line
break, so a text may be cut at these places first without changing its best way; each distinct part is then searched
once a batch, all parts at a time.

A BPE model has merge ranks in the place of log scores. They are read as Zipf's law has it: the r-th piece has a
probability in proportion to 1 / (r + ZIPF). A unigram model's scores are taken as they are.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grainmill.llm import pretokens
from grainmill.llm._common import ship, table

MARK = "▁"
#: Zipf's shift; what an unknown character costs beyond the lowest score (a fixed value of the format).
ZIPF, UNKNOWN = 2.7, 10.0
#: Parts of up to so many bytes are searched all at a time; longer ones singly.
LONG = 48
#: Bytes of text that are encoded at a time; parts whose ids a worker keeps.
ENCODE_BYTES, CACHE_ENTRIES = 1 << 20, 150_000

#: Parts that are searched at a time.
STEP = 8_192
#: Slots that the trie's builder looks at together.
WINDOW = 64

NORMAL, UNK, CONTROL, USER, BYTE = 1, 2, 3, 4, 6


def build_trie(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A double array over the keys: node t has the child c at base[t] + c if check there is t. value[t]: the key's number, or -1.

    Node 0 is the root; children are numbered by byte + 1.
    """
    order = sorted(range(len(keys)), key=lambda i: keys[i])
    size = 1 << 16
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    check[0], free, dense = 0, 257, 257
    todo = [(0, 0, len(order), 0)]
    while todo:
        node, lo, hi, depth = todo.pop()
        while lo < hi and len(keys[order[lo]]) == depth:
            value[node] = order[lo]
            lo += 1
        if lo == hi:
            continue
        groups, at = [], lo
        while at < hi:
            byte, to = keys[order[at]][depth], at
            while to < hi and keys[order[to]][depth] == byte:
                to += 1
            groups.append((byte + 1, at, to))
            at = to
        codes = np.array([g[0] for g in groups])
        if free + 2 * WINDOW + 520 >= len(check):
            grow = len(check)
            base, check, value = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([check, np.full(grow, -1, np.int32)]), np.concatenate([value, np.full(grow, -1, np.int32)])
        b, at = free - int(codes[0]), max(free, dense)
        while len(codes) > 1:  # the first place from which all children's slots are free, seen a window at a time
            if at + WINDOW + 520 >= len(check):
                grow = len(check)
                base, check, value = np.concatenate([base, np.zeros(grow, np.int32)]), np.concatenate([check, np.full(grow, -1, np.int32)]), np.concatenate([value, np.full(grow, -1, np.int32)])
            first = at + np.flatnonzero(check[at : at + WINDOW] == -1) - codes[0]
            fits = first[(check[first[:, None] + codes] == -1).all(axis=1)]
            if len(fits):
                b = int(fits[0])
                break
            at += WINDOW
            dense = at  # later nodes with several children do not look here again
        base[node], check[b + codes] = b, node
        while free < len(check) and check[free] != -1:
            free += 1
        todo += [(b + c, at, to, depth + 1) for c, at, to in groups]
    used = int(np.flatnonzero(check >= 0).max()) + 260
    return base[:used].copy(), check[:used].copy(), value[:used].copy()


def read_pieces(content: bytes) -> tuple[list[str], np.ndarray, np.ndarray, dict]:
    """Pieces, log scores and kinds of a model file's content, and its options."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    model.ParseFromString(content)
    if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
        raise ValueError("models that rewrite characters or drop spaces are not supported")
    pieces, kinds = [p.piece for p in model.pieces], np.array([p.type for p in model.pieces])
    scores = np.array([p.score for p in model.pieces], dtype=np.float64)
    if model.trainer_spec.model_type == 2:
        rank = np.cumsum(kinds == NORMAL).astype(np.float64)
        scores = np.where(kinds == NORMAL, -np.log(rank + ZIPF), 0.0)
        scores -= np.where(kinds == NORMAL, np.log(np.exp(scores[kinds == NORMAL]).sum()), 0.0)
    return pieces, scores, kinds, {"prefix": model.normalizer_spec.add_dummy_prefix}


def compiled(content: bytes) -> tuple:
    """What Unigram needs of a model file's content, with the trie built: some MB, whatever the corpus."""
    pieces, scores, kinds, options = read_pieces(content)
    listed = np.flatnonzero((kinds == NORMAL) | (kinds == USER))
    return pieces, scores, kinds, options["prefix"], listed, build_trie([pieces[i].encode() for i in listed])


class Unigram:
    """encode_texts() and decode() for what compiled() makes of a model file's content."""

    def __init__(self, pieces, scores, kinds, prefix, listed, trie):
        self.prefix = prefix
        keys = [pieces[i].encode() for i in listed]
        self.base, self.check, value = trie
        self.value = np.where(value >= 0, listed[value], -1).astype(np.int32)
        self.score = scores.astype(np.float32).astype(np.float64)
        self.unknown = float(self.score[listed].min()) - UNKNOWN
        self.longest = max(map(len, keys))
        self.byte_id = np.full(256, int(np.flatnonzero(kinds == UNK)[0]), dtype=np.int32)
        for i in np.flatnonzero(kinds == BYTE):
            self.byte_id[int(pieces[i][3:5], 16)] = i
        surface = [b"" if k == CONTROL else bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(MARK, " ").encode() for p, k in zip(pieces, kinds, strict=True)]
        self.is_byte = kinds == BYTE
        self.out_len = np.array([len(x) for x in surface], dtype=np.int64)
        self.out_start = np.cumsum(self.out_len) - self.out_len
        self.out_flat = np.frombuffer(b"".join(surface), dtype=np.uint8)
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in (pieces[i] for i in listed)):
            raise ValueError("a piece crosses the places where texts are cut")
        self.cache: dict[str, int] = {}
        self.lists: list[list] | None = None
        self.start = self.length = np.zeros(0, dtype=np.int64)
        self.flat = np.zeros(0, dtype=np.int32)

    def split(self, texts: pa.Array) -> pa.Array:
        """The marked texts' parts: a run of marks with what follows it, or a line break, or what follows a line break."""
        texts = pc.replace_substring(texts, MARK, " ")
        marked = pc.replace_substring(texts, " ", f" {MARK}")
        if self.prefix:
            marked = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(MARK, marked, ""))
        while pc.any(pc.match_substring(marked, f"{MARK} {MARK}")).as_py():
            marked = pc.replace_substring(marked, f"{MARK} {MARK}", MARK * 2)
        return pc.split_pattern(pc.replace_substring(marked, "\n", " \n "), " ")

    def _single(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """best and back of the Viterbi search through one part."""
        if self.lists is None:  # plain lists are faster to step through; made once
            self.lists = [x.tolist() for x in (self.base, self.check, self.value, self.score)]
        n, (base, check, value, score) = len(text), self.lists
        best, back = [-np.inf] * (n + 1), [0] * (n + 1)
        best[0] = 0.0
        for s in range(n):
            if text[s] & 0xC0 == 0x80:
                continue
            first = text[s]
            width = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
            node, alone, at = 0, False, s
            while at < n:
                child = base[node] + text[at] + 1
                if child >= len(check) or check[child] != node:
                    break
                node, at = child, at + 1
                if value[node] >= 0:
                    alone |= at == s + width
                    if (x := best[s] + score[value[node]]) > best[at]:
                        best[at], back[at] = x, value[node] << 24 | at - s
            if not alone and (x := best[s] + self.unknown) > best[s + width]:
                best[s + width], back[s + width] = x, -width
        return np.array(back, dtype=np.int64)

    def _many(self, flat: np.ndarray, length: np.ndarray) -> np.ndarray:
        """back of the search through parts of up to LONG bytes, a row of bytes each; all parts advance together."""
        rows, width = flat.shape
        best = np.full((rows, width + 1), -np.inf)
        back = np.zeros((rows, width + 1), dtype=np.int64)
        best[:, 0] = 0.0
        lead = flat
        wide = np.where(lead < 0x80, 1, np.where(lead < 0xE0, 2, np.where(lead < 0xF0, 3, 4)))
        for s in range(width):
            live = np.flatnonzero((length > s) & (lead[:, s] & 0xC0 != 0x80))
            if not len(live):
                continue
            here, char = best[live, s], wide[live, s]
            alone = np.zeros(len(live), dtype=bool)
            place, node = np.arange(len(live)), np.zeros(len(live), dtype=np.int64)
            for at in range(s, min(width, s + self.longest)):
                inside = length[live[place]] > at
                place, node = place[inside], node[inside]
                child = self.base[node] + flat[live[place], at].astype(np.int64) + 1
                child = np.minimum(child, len(self.check) - 1)
                goes = self.check[child] == node
                place, node = place[goes], child[goes]
                if not len(place):
                    break
                piece = self.value[node]
                ends = piece >= 0
                p, piece = place[ends], piece[ends].astype(np.int64)
                alone[p] |= char[p] == at + 1 - s
                x, row = here[p] + self.score[piece], live[p]
                better = x > best[row, at + 1]
                row = row[better]
                best[row, at + 1] = x[better]
                back[row, at + 1] = piece[better] << 24 | at + 1 - s
            p = np.flatnonzero(~alone)
            row, to = live[p], s + char[p]
            x = here[p] + self.unknown
            better = x > best[row, to]
            best[row[better], to[better]] = x[better]
            back[row[better], to[better]] = -char[p][better]
        return back

    def _trace(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of each part, from the ends backwards."""
        out: list[list[int]] = [[] for _ in texts]
        size = np.array([len(t) for t in texts], dtype=np.int64)
        for lo, hi in ((0, 8), (8, 12), (12, 20), (20, LONG)):
            rows = np.flatnonzero((size > lo) & (size <= hi))
            if not len(rows):
                continue
            grid = np.zeros((len(rows), hi), dtype=np.uint8)
            length = size[rows]
            joined = np.frombuffer(b"".join(texts[i] for i in rows), dtype=np.uint8)
            grid[np.arange(hi) < length[:, None]] = joined
            back = self._many(grid, length)
            end, live, steps = length.copy(), np.arange(len(rows)), []
            while len(live):
                b = back[live, end[live]]
                steps.append((live, b, end[live]))
                end[live] -= np.where(b < 0, -b, b & 0xFFFFFF)
                live = live[end[live] > 0]
            for live, b, to in reversed(steps):
                for r, x, e in zip(rows[live].tolist(), b.tolist(), to.tolist(), strict=True):
                    out[r].extend([x >> 24] if x >= 0 else self.byte_id[list(texts[r][e + x : e])].tolist())
        for i in np.flatnonzero(size > LONG):
            back, end, ids = self._single(texts[i]), int(size[i]), []
            while end > 0:
                b = int(back[end])
                if b < 0:
                    ids.append(self.byte_id[list(texts[i][end + b : end])].tolist())
                    end += b
                else:
                    ids.append([b >> 24])
                    end -= b & 0xFFFFFF
            out[i] = [x for piece in reversed(ids) for x in piece]
        return out

    def _slots(self, parts: list[str]) -> np.ndarray:
        new = [p for p in parts if p not in self.cache]
        if new and len(self.cache) > CACHE_ENTRIES:  # the older half stays: the common parts came first
            half = CACHE_ENTRIES // 2
            self.cache = {p: i for p, i in self.cache.items() if i < half}
            self.start, self.length = self.start[:half], self.length[:half]
            self.flat = self.flat[: int(self.start[-1] + self.length[-1])].copy()
            new = [p for p in parts if p not in self.cache]
        for at in range(0, len(new), STEP):
            part = new[at : at + STEP]
            ids = self._trace([p.encode() for p in part])
            n = np.array([len(x) for x in ids], dtype=np.int64)
            self.cache.update(zip(part, range(len(self.start), len(self.start) + len(part)), strict=True))
            self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(n) - n])
            self.length, self.flat = np.concatenate([self.length, n]), np.concatenate([self.flat, np.array([i for x in ids for i in x], dtype=np.int32)])
        return np.fromiter(map(self.cache.__getitem__, parts), dtype=np.int64, count=len(parts))

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one after the other, and the len(texts) + 1 offsets of the texts in them."""
        parts, codes, ends = pretokens.factorized(self.split(texts))
        slots = self._slots(parts.to_pylist())
        at, n = pretokens.ragged(self.start, self.length, slots[codes] if len(slots) else codes)
        return self.flat[at], np.concatenate([[0], np.cumsum(n)])[ends]

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The UTF-8 texts of documents with the ids ids[ends[i]:ends[i + 1]]: marks as spaces, without the one in front."""
        at, n = pretokens.ragged(self.out_start, self.out_len, ids)
        data, cuts = self.out_flat[at].tobytes(), np.concatenate([[0], np.cumsum(n)])[ends]
        skip = int(self.prefix)
        out = []
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            out.append(data[a + skip : b] if skip and data[a : a + 1] == b" " and b > a else data[a:b])
        return out


_loaded: dict[str, Unigram] = {}


def load(shared) -> Unigram:
    """The model of a broadcast (key, compiled content), kept for the later tasks of this worker."""
    key, parts = shared.value
    if key not in _loaded:
        _loaded[key] = Unigram(*parts)
    return _loaded[key]


def _shared(spark, path: str):
    with open(path, "rb") as f:
        content = f.read()
    return spark.sparkContext.broadcast((hashlib.sha256(content).hexdigest(), compiled(content)))


def _encode(content, keep: list[str]):
    def run(batches):
        pretokens.trim()
        model = load(content)
        for batch in batches:
            texts = pretokens.text_column(batch)
            for at, to in pretokens.slices(texts, ENCODE_BYTES):
                own = texts.slice(at, to - at)
                ids, ends = model.encode_texts(own)
                decoded = model.decode(ids, ends)
                same = [x == y for x, y in zip(decoded, own.cast(pa.binary()).to_pylist(), strict=True)]
                n_bytes = np.concatenate([[0], np.cumsum(model.is_byte[ids])])[ends]
                listed = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids))
                columns = [batch.column(c).slice(at, to - at) for c in keep]
                new = [listed, pa.array(np.diff(ends)), pa.array(np.diff(n_bytes)), pa.array(same)]
                yield pa.RecordBatch.from_arrays([*columns, *new], names=[*keep, "ids", "n_ids", "n_byte_ids", "round_trip"])
            pretokens.trim()

    return run


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, n_ids, n_byte_ids, round_trip for each row of docs(doc_id, text), by the model file at path.

    n_byte_ids counts the pieces of byte fallback. round_trip: decoding the ids gives the text back, which fails only
    for a text that has the mark U+2581 itself. A null text counts as empty and has no ids. Rows that repeat give rows
    that repeat. Each text is encoded whole, by one task; nothing is shuffled.
    """
    spark = docs.sparkSession
    ship(spark)
    content = _shared(spark, path)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_encode(content, ["doc_id"]), "doc_id long, ids array<int>, n_ids long, n_byte_ids long, round_trip boolean")


def _decode(content):
    def run(batches):
        model = load(content)
        for batch in batches:
            listed = batch.column("ids")
            listed = pc.if_else(pc.is_null(listed), pa.scalar([], listed.type), listed) if listed.null_count else listed
            ends = np.asarray(listed.offsets)
            texts = model.decode(np.asarray(listed.values)[ends[0] : ends[-1]], ends - ends[0])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return run


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text for each row of encoded(doc_id, ids). Bytes that are not UTF-8 become U+FFFD; null ids an empty text."""
    spark = encoded.sparkSession
    ship(spark)
    content = _shared(spark, path)
    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(content), "doc_id long, text string")


def op1_sentencepiece(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"))
