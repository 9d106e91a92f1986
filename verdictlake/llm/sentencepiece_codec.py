"""SentencePiece encoding and decoding by batched Viterbi search in numpy.

A text is cut where no piece can reach across: before each run of spaces, and around line ends that no piece holds. The
distinct words of a batch are laid out by length, and words of a length advance together, one end position a step: prefix
hashes give the hash of every substring, which is looked for in the sorted piece hashes (from where its leading bits point,
and compared by a second hash), and the maximum over the last pieces is stored with a pointer back. A place goes on only
with the substrings that some piece begins with.

For unigram models a path scores the sum of its pieces. For merge (BPE) models that sum isn't what the model means: there
every prefix of a word has just one segmentation by merges, and a piece may follow another only if no merge would have
crossed their border. The search keeps the paths all of whose neighbours pass, so it gives the same ids as merging does.
Long words, such as texts without spaces, are first cut between letters that stand side by side in no piece.
Letters without a piece become the model's byte pieces, or its unknown piece.

Defined cases: null and empty texts give no ids; decoding gives the text back exactly, but for texts that hold the space
marker itself (it decodes to a space) or letters unknown to a model without bytes; repeated rows each get their result; a
null id stays; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.llm.common import release

SPACE = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
#: Words that a task remembers, and letters from which a word is first cut where no piece reaches across.
REMEMBERED, LONG = 300_000, 16
_BASE, _BASE_2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _spread(h: np.ndarray) -> np.ndarray:
    """Hashes whose leading bits tell apart, short strings' too."""
    with np.errstate(over="ignore"):
        return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


#: A control character at which kernels cut.
_CUT = "\x01"
_SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")


def _pairs(text: str) -> np.ndarray:
    """Each letter with the next one, as a number."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return points[:-1] << 21 | points[1:]


class Vocabulary:
    """A model's pieces, small enough to broadcast (tens of bytes a piece)."""

    def __init__(self, pieces: list[str], scores: list[float], kinds: list[int], algorithm: int, dummy_prefix: bool):
        self.pieces, self.scores, self.kinds, self.algorithm, self.dummy_prefix = pieces, np.array(scores), np.array(kinds), algorithm, dummy_prefix
        own = [i for i, k in enumerate(kinds) if k in (NORMAL, USER) and pieces[i]]
        self.longest = max(len(pieces[i]) for i in own)
        self.name = hashlib.sha256(repr((pieces, scores, kinds, algorithm, dummy_prefix)).encode()).hexdigest()
        hashes, second = np.zeros(len(own), np.uint64), np.zeros(len(own), np.uint64)
        begins: set[int] = set()
        with np.errstate(over="ignore"):
            for k, i in enumerate(own):
                h = g = np.uint64(0)
                for c in np.frombuffer(pieces[i].encode("utf-32-le"), np.uint32):
                    h, g = h * _BASE + np.uint64(c) + np.uint64(1), g * _BASE_2 + np.uint64(c) + np.uint64(1)
                    begins.add(int(_spread(h)) >> 43)
                hashes[k], second[k] = _spread(h), g
            self.powers = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, _BASE)])
            self.powers_2 = np.cumprod(np.r_[np.uint64(1), np.full(self.longest, _BASE_2)])
        order = np.argsort(hashes)
        self.keys, self.second, self.ids = hashes[order], second[order], np.array(own, np.int64)[order]
        #: where the sorted keys with given leading bits start, and how many there are at most
        self.start = np.searchsorted(self.keys >> np.uint64(47), np.arange((1 << 17) + 1).astype(np.uint64))
        self.most = int(np.diff(self.start).max())
        self.begins = np.zeros(1 << 21, bool)
        self.begins[list(begins)] = True
        self.bytes_ = np.array([-1] * 256)
        for i, k in enumerate(kinds):
            if k == BYTE:
                self.bytes_[int(pieces[i][3:5], 16)] = i
        self.unknown = kinds.index(UNKNOWN) if UNKNOWN in kinds else 0
        self.unknown_score = float(self.scores[own].min()) - 10
        # side by side in some piece; where two letters are in none, a word falls apart
        self.pairs = np.unique(np.concatenate([np.zeros(0, np.int64), *(_pairs(pieces[i]) for i in own)]))
        self.line_end = "\n" not in "".join(pieces[i] for i in own)
        self.raw = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else (b" \xe2\x81\x87 " if k == UNKNOWN else b"") for p, k in zip(pieces, kinds, strict=True)]
        self.raw_sizes, self.raw_bytes = np.array([len(r) for r in self.raw], np.int64), np.frombuffer(b"".join(self.raw), np.uint8)
        self.raw_starts = np.cumsum(np.r_[0, self.raw_sizes[:-1]])
        if algorithm == BPE:
            self._merges(own)

    def parts(self, word: str) -> list[str]:
        """The parts of a word that no piece reaches across, so that each is encoded on its own. Models that join unknown letters get it whole."""
        if not (self.bytes_ >= 0).all():
            return [word]
        pairs = _pairs(word)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        cuts = [0, *(np.flatnonzero(self.pairs[at] != pairs) + 1).tolist(), len(word)]
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    @classmethod
    def load(cls, path: str = MODEL) -> Vocabulary:
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        if model.normalizer_spec.precompiled_charsmap or model.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models that leave texts as they are can be decoded exactly")
        return cls([p.piece for p in model.pieces], [p.score for p in model.pieces], [p.type for p in model.pieces], model.trainer_spec.model_type, model.normalizer_spec.add_dummy_prefix)

    def _merges(self, own: list[int]) -> None:
        """Ranks, the pairs of pieces that merge, and each piece's outer parts as merging builds it up."""
        by_text = {self.pieces[i]: i for i in own}
        rank = np.full(len(self.pieces), np.iinfo(np.int64).max)
        for r, i in enumerate(sorted(own, key=lambda i: (-self.scores[i], i))):
            rank[i] = r
        self.rank = rank
        pairs = sorted((by_text[p[:k]] << 32 | by_text[p[k:]], i) for p, i in by_text.items() for k in range(1, len(p)) if p[:k] in by_text and p[k:] in by_text)
        self.pair_keys, self.pair_ids = np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int64)
        split: dict[int, tuple[int, int] | None] = {}
        lead = dict(pairs)
        for p, i in by_text.items():
            parts = [by_text.get(c, -1) for c in p]
            last = None
            while len(parts) > 1:
                merged = [(rank[m], k, m) for k in range(len(parts) - 1) if parts[k] >= 0 and parts[k + 1] >= 0 and (m := lead.get(parts[k] << 32 | parts[k + 1], -1)) >= 0]
                if not merged:
                    break
                _, k, m = min(merged)
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [m]
            split[i] = last if parts == [i] else None
        #: pieces that merging never gives can't be on a path
        self.reachable = np.zeros(len(self.pieces), bool)
        left: dict[int, list[int]] = {}
        right: dict[int, list[int]] = {}
        for i in sorted(by_text.values(), key=lambda i: len(self.pieces[i])):
            if len(self.pieces[i]) == 1:
                left[i], right[i], self.reachable[i] = [i], [i], True
            elif split[i] and split[i][0] in left and split[i][1] in left:
                left[i], right[i], self.reachable[i] = [i, *left[split[i][0]]], [i, *right[split[i][1]]], True
        deep = max(map(len, left.values()))
        self.left, self.right = np.full((len(self.pieces), deep), -1), np.full((len(self.pieces), deep), -1)
        for table, found in ((self.left, left), (self.right, right)):
            for i, chain in found.items():
                table[i, : len(chain)] = chain

    def may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the letters of pieces a and b, side by side, gives a and b.

        The last part of a and the first part of b grow along their chains in order of rank; a merge crosses the border if
        two parts exist at the same time and merge before either is merged into the next part of its own chain.
        """
        ok, top = np.ones(len(a), bool), np.iinfo(np.int64).max
        for x in range(self.right.shape[1]):
            p = self.right[a, x]
            if (p < 0).all():
                break
            p_next = self.rank[self.right[a, x - 1]] if x else np.full(len(a), top)
            for y in range(self.left.shape[1]):
                q = self.left[b, y]
                live = np.flatnonzero(ok & (p >= 0) & (q >= 0))
                if not len(live):
                    break
                q_next = self.rank[self.left[b[live], y - 1]] if y else np.full(len(live), top)
                born, ends = np.maximum(self.rank[p[live]] * (x < self._depth(self.right, a[live])), self.rank[q[live]] * (y < self._depth(self.left, b[live]))), np.minimum(p_next[live], q_next)
                both = born < ends
                live, q_next, born = live[both], q_next[both], born[both]
                key = p[live] << 32 | q[live]
                at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
                hit = self.pair_keys[at] == key
                live, q_next, born = live[hit], q_next[hit], born[hit]
                merge = np.maximum(self.rank[self.pair_ids[at[hit]]], born)
                crosses = (merge < p_next[live]) & (merge <= q_next)
                ok[live[crosses]] = False
        return ok

    @staticmethod
    def _depth(table: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The place of the last part, a single letter, which exists from the start."""
        return (table[i] >= 0).sum(1) - 1


_ENCODERS: dict[str, Encoder] = {}


def encoder_of(vocabulary: Vocabulary) -> Encoder:
    """The process's encoder for a vocabulary; what it remembers serves later tasks too."""
    if vocabulary.name not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[vocabulary.name] = Encoder(vocabulary)
    return _ENCODERS[vocabulary.name]


class Encoder:
    """Encodes batches, remembering words and neighbours that were looked at before."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.words: dict[str, bytes] = {}
        self.seen = np.full(1 << 20, -1, np.int64)
        self.verdict = np.zeros(1 << 20, bool)

    def _may_follow(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        slot = ((key.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(44)).astype(np.int64)
        fresh = np.flatnonzero(self.seen[slot] != key)
        out = self.verdict[slot]
        if len(fresh):
            keys, back = np.unique(key[fresh], return_inverse=True)
            found = self.v.may_follow(keys >> 32, keys & 0xFFFFFFFF)
            out[fresh] = found[back]
            self.seen[slot[fresh]], self.verdict[slot[fresh]] = key[fresh], out[fresh]
        return out

    def _find(self, prefix: np.ndarray, prefix_2: np.ndarray, i: int, j: int, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the live rows: those whose letters i to j are a piece, the pieces, and those with which a piece begins."""
        v = self.v
        h = _spread(prefix[j, live] - prefix[i, live] * v.powers[j - i])
        going = v.begins[h >> np.uint64(43)]
        live, h = live[going], h[going]
        at = v.start[(h >> np.uint64(47)).astype(np.int64)]
        place = np.full(len(h), -1)
        for k in range(v.most):
            x = np.minimum(at + k, len(v.keys) - 1)
            place = np.where(v.keys[x] == h, x, place)
        hit = np.flatnonzero(place >= 0)
        rows, place = live[hit], place[hit]
        same = prefix_2[j, rows] - prefix_2[i, rows] * v.powers_2[j - i] == v.second[place]
        return rows[same], v.ids[place[same]], live

    def _viterbi(self, words: list[str], length: int) -> list[bytes]:
        """Ids, as bytes of 32-bit numbers, of words of one length (longer ones are filled up with zeros)."""
        v, n = self.v, len(words)
        points = np.frombuffer("".join(w.ljust(length, "\0") for w in words).encode("utf-32-le"), np.uint32).reshape(n, length)
        points = np.ascontiguousarray(points.T)  # a row for each place, as words advance together
        prefix, prefix_2 = np.zeros((length + 1, n), np.uint64), np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            prefix[j + 1] = prefix[j] * _BASE + points[j] + np.uint64(1)
            prefix_2[j + 1] = prefix_2[j] * _BASE_2 + points[j] + np.uint64(1)
        best, size, last = np.full((length + 1, n), -np.inf), np.zeros((length + 1, n), np.int64), np.full((length + 1, n), -1, np.int64)
        best[0] = 0
        live: dict[int, np.ndarray] = {}
        for j in range(1, length + 1):
            live[j - 1] = np.arange(n)
            live.pop(j - 1 - v.longest, None)
            for i in sorted(live):
                if not len(live[i]):
                    continue
                rows, ids, live[i] = self._find(prefix, prefix_2, i, j, live[i])
                if j - i == 1:  # a letter without a piece stands alone
                    known = np.zeros(n, bool)
                    known[rows] = True
                    lone = np.flatnonzero(~known)
                    score = best[i, lone] + v.unknown_score
                    up = score > best[j, lone]
                    best[j, lone[up]], size[j, lone[up]], last[j, lone[up]] = score[up], 1, -2
                if v.algorithm == BPE and len(rows):
                    rows, ids = (x[v.reachable[ids] & (best[i, rows] > -np.inf)] for x in (rows, ids))
                    check = np.flatnonzero(last[i, rows] >= 0)
                    if len(check):
                        ok = np.ones(len(rows), bool)
                        ok[check] = self._may_follow(last[i, rows[check]], ids[check])
                        rows, ids = rows[ok], ids[ok]
                score = best[i, rows] + (0.0 if v.algorithm == BPE else v.scores[ids])
                up = score > best[j, rows]
                rows, ids, score = rows[up], ids[up], score[up]
                best[j, rows], size[j, rows], last[j, rows] = score, j - i, ids
        # all rows walk back together
        at, step = np.array([len(w) for w in words]), 0
        path = np.full((n, length), -1, np.int64)
        rows = np.arange(n)
        while (live := at > 0).any():
            path[live, length - 1 - step] = last[at[live], rows[live]]
            lone = live & (path[:, length - 1 - step] == -2)
            path[lone, length - 1 - step] = -2 - points[at[lone] - 1, rows[lone]].astype(np.int64)
            at[live] -= size[at[live], rows[live]]
            step += 1
        flat, odd = path[path != -1], (path < -1).any(1)
        counts = (path != -1).sum(1)
        blob, cuts = flat.astype("<i4").tobytes(), np.r_[0, np.cumsum(counts)] * 4
        return [self._spelled(path[k][path[k] != -1]) if odd[k] else blob[cuts[k] : cuts[k + 1]] for k in range(n)]

    def _spelled(self, path: np.ndarray) -> bytes:
        """A path with letters that have no piece, as byte pieces or the unknown piece (one for a run of letters)."""
        out: list[int] = []
        for x in path.tolist():
            if x >= 0:
                out.append(x)
            elif (self.v.bytes_ >= 0).all():
                out += self.v.bytes_[list(chr(-2 - x).encode("utf-8", "replace"))].tolist()
            elif not out or out[-1] != self.v.unknown:
                out.append(self.v.unknown)
        return np.array(out, "<i4").tobytes()

    def _learn(self, words: Iterable[str]) -> None:
        alone, made = set(), {}
        for w in words:
            parts = self.v.parts(w) if len(w) > LONG and len(self.v.pairs) else [w]
            if len(parts) > 1:
                made[w] = parts
                alone.update(p for p in parts if p not in self.words)
            else:
                alone.add(w)
        self._search(alone)
        for w, parts in made.items():
            self.words[w] = b"".join(self.words[p] for p in parts)

    def _search(self, words: Iterable[str]) -> None:
        by_size: dict[int, list[str]] = {}
        for w in words:
            by_size.setdefault(len(w) if len(w) <= 32 else -(-len(w) // 32) * 32, []).append(w)
        for length, same in by_size.items():
            step = max(1, 400_000 // length)
            for at in range(0, len(same), step):
                part = same[at : at + step]
                self.words.update(zip(part, self._viterbi(part, length), strict=True))

    def segments(self, text: str) -> list[str]:
        """The parts of a text that are encoded on their own."""
        out: list[str] = []
        for k, line in enumerate(text.split("\n") if self.v.line_end else [text]):
            head = k == 0 and self.v.dummy_prefix
            if k:
                out.append("\n")
            if "  " in line or SPACE in line or (head and line[:1] == " "):
                out += _SEGMENT.findall((SPACE if head else "") + line.replace(" ", SPACE))
                continue
            first, *more = line.split(" ")
            if head or first:
                out.append(SPACE + first if head else first)
            out += [SPACE + w for w in more]
        return out

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """The segments of each text. Arrow's kernels cut most texts; those that hold the mark they cut at, or the space marker, are cut one by one."""
        texts = pc.fill_null(texts, "")
        odd = pc.or_(pc.match_substring(texts, _CUT), pc.match_substring(texts, SPACE)).to_numpy(zero_copy_only=False)
        t = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise(" ", texts, "")) if self.v.dummy_prefix else texts
        t = pc.replace_substring(t, "\n", f"{_CUT}\n{_CUT}") if self.v.line_end else t
        cut = pc.split_pattern(pc.replace_substring_regex(t, "( +)", _CUT + r"\1"), _CUT)
        if odd.any():
            rows = cut.to_pylist()
            for k in np.flatnonzero(odd):
                rows[k] = self.segments(texts[int(k)].as_py())
            cut = pa.array(rows, pa.list_(pa.string()))
        return cut

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a column one after the other, and how many each text has."""
        cut = self._cut(texts)
        coded = cut.flatten().dictionary_encode()
        if len(self.words) > REMEMBERED:
            self.words.clear()
        words = [w.replace(" ", SPACE) for w in coded.dictionary.to_pylist()]
        self._learn({w for w in words if w}.difference(self.words))
        own = [self.words[w] if w else b"" for w in words]
        n = np.fromiter(map(len, own), np.int64, len(own)) // 4
        starts, flat = np.r_[0, np.cumsum(n)], np.frombuffer(b"".join(own), "<i4")
        index = coded.indices.to_numpy()
        sizes = n[index]
        ends = np.cumsum(sizes)
        ids = flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[index] - ends + sizes, sizes)]
        offsets = cut.offsets.to_numpy() - cut.offsets[0].as_py()
        return ids, np.diff(np.r_[0, ends][offsets])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        ids, sizes = self.encode_column(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(sizes)[:-1]) if len(texts) else []

    def decode_column(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        size = self.v.raw_sizes[ids]
        ends = np.cumsum(size)
        blob = self.v.raw_bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.v.raw_starts[ids] - ends + size, size)].tobytes()
        cuts = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]].tolist()
        prefix = self.v.dummy_prefix
        return [blob[a + (prefix and blob[a : a + 1] == b" ") * (a < b) : b].decode("utf-8", "replace") for a, b in zip(cuts, cuts[1:], strict=False)]

    def decode(self, ids: Iterable[int]) -> str:
        text = b"".join(map(self.v.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.v.dummy_prefix and text[:1] == " " else text


def _batches(whole: pa.RecordBatch, column: int, most: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with a bounded number of bytes of text, or one row."""
    sizes = pc.fill_null(pc.binary_length(whole.column(column)), 0).to_numpy()
    at = 0
    while at < whole.num_rows:
        n = max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most)))
        yield whole.slice(at, n)
        at += n


def encode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, exact (whether decoding the ids gave the text back)."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_tokens", T.LongType()), T.StructField("exact", T.BooleanType())])
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what tasks of other stages left in this worker
        encoder = encoder_of(held.value)
        for whole in batches:
            for b in _batches(whole, 1):
                ids, sizes = encoder.encode_column(b.column(1))
                back = pa.array(encoder.decode_column(ids, sizes), pa.string())
                exact = pc.equal(back, pc.fill_null(b.column(1), ""))
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, pa.array(sizes, pa.int64()), exact], schema.names)

    return source.mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: Vocabulary, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text."""
    source = df.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    schema = T.StructType([T.StructField("doc_id", source.schema["doc_id"].dataType), T.StructField("text", T.StringType())])
    held = df.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(held.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([encoder.decode(x.as_py() or []) for x in b.column(1)], pa.string())], schema.names)

    return source.mapInArrow(run, schema)
