"""Operator 9: SentencePiece encoding and decoding for merge-type vocabularies.

The text gets a leading space, spaces become U+2581, and a score-ordered agenda of adjacent symbol
pairs is worked off: the pair whose joined piece scores highest is merged first, ties from the left.
Characters outside the vocabulary become byte pieces. A merge can join two characters only if some
piece holds them side by side. So the text is cut before runs of U+2581, at line ends and between a
word and its stop, where the vocabulary allows it, and the cuts' encodings are remembered, up to a bound.

Nulls and empty texts have no ids and decode to the empty string. Rows are handled one by one, so
order, ties and repeats do not matter. Extra columns pass through encode_decode() untouched.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import table, text_batches

SPACE = "▁"
#: Cuts whose encoding a worker remembers, in each of two generations.
REMEMBERED = 400_000
#: Characters of texts whose words are told apart at once.
SLICE = 1 << 22
#: Words that are encoded together, and the length from which they are encoded alone.
TOGETHER, LONGEST = 20_000, 32
MODEL = "piece_bpe_32k.model"


def model_path(name: str = MODEL) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Vocabulary:
    """Pieces and scores of a model, and the encoder over them."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        ids = list(range(n))
        self.pieces = sp.id_to_piece(ids)
        special = {i for i in ids if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.byte_ids.items()}
        self.unknown = sp.unk_id()
        normal = [i for i in ids if i not in special and i not in self.byte_of]
        self.ids = {self.pieces[i]: i for i in normal}
        self.scores = {self.pieces[i]: sp.get_score(i) for i in normal}
        self.controls = special - {self.unknown}
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        self.stops, self.by_split = "", False
        if any(p[1] == SPACE and p[0] != SPACE for p in pairs):  # a piece goes on over a space: no cut is safe
            self.cut = re.compile("(?s).+")
        else:
            end = "\n" if not any("\n" in p for p in pairs) else ""
            stop = "".join(c for c in ".,;:" if not any(p[1] == c and p[0].isalpha() for p in pairs))
            self.stops, self.by_split = stop, bool(end)
            self.cut = re.compile(f"{SPACE}*[^{SPACE}{end}]+|{SPACE}+" + (f"|{end}" if end else ""))
        self.plain_from = max([*special, *self.byte_of])
        self._joins: tuple | None = None
        self._new: dict[str, tuple] = {}
        self._old: dict[str, tuple] = {}

    def _symbol(self, s: str) -> list[int]:
        i = self.ids.get(s)
        if i is not None:
            return [i]
        if self.byte_ids:
            return [self.byte_ids[b] for b in s.encode()]
        return [self.unknown]

    def merge(self, text: str) -> list[int]:
        """Ids of one cut, by the agenda."""
        sym = list(text)
        score = self.scores.get
        if len(sym) <= 40:
            agenda = [score(a + b, -1e30) for a, b in zip(sym, sym[1:], strict=False)]
            while agenda:
                best = max(agenda)
                if best == -1e30:
                    break
                i = agenda.index(best)
                sym[i] += sym.pop(i + 1)
                del agenda[i]
                if i < len(agenda):
                    agenda[i] = score(sym[i] + sym[i + 1], -1e30)
                if i:
                    agenda[i - 1] = score(sym[i - 1] + sym[i], -1e30)
        else:
            left, right = list(range(-1, len(sym) - 1)), [*range(1, len(sym)), -1]
            heap = [(-v, i, i + 1, len(sym[i]) + len(sym[i + 1])) for i in range(len(sym) - 1) if (v := score(sym[i] + sym[i + 1])) is not None]
            heapq.heapify(heap)
            while heap:
                _, a, b, size = heapq.heappop(heap)
                if not sym[a] or not sym[b] or right[a] != b or len(sym[a]) + len(sym[b]) != size:
                    continue
                sym[a] += sym[b]
                sym[b] = ""
                right[a] = right[b]
                if right[b] >= 0:
                    left[right[b]] = a
                for x, y in ((left[a], a), (a, right[a])):
                    if x >= 0 and y >= 0 and (v := score(sym[x] + sym[y])) is not None:
                        heapq.heappush(heap, (-v, x, y, len(sym[x]) + len(sym[y])))
            sym = [s for s in sym if s]
        ids = [self.ids.get(s) for s in sym]
        return [i for s in sym for i in self._symbol(s)] if None in ids else ids

    def _cut_ids(self, cut: str | tuple[str]) -> list[int]:
        if isinstance(cut, tuple):
            return self.merge(cut[0])
        if cut[0] == "\n":
            return self._symbol("\n") + self.merge(cut[1:])
        if cut[-1] in self.stops and cut[:-1].isalpha():
            return [*map(int, self.remembered(cut[:-1])[1].split(",")), *self.merge(cut[-1])]
        return self.merge(SPACE + cut)

    def remembered(self, cut: str | tuple[str]) -> tuple:
        """(number of ids, ids as text, text again, first id) of one cut."""
        found = self._new.get(cut)
        if found is None:
            found = self._old.get(cut)
            if found is None:
                ids = self._cut_ids(cut)
                found = (len(ids), ",".join(map(str, ids)), self._surface(ids), ids[0])
            if len(self._new) >= REMEMBERED:
                self._old, self._new = self._new, {}
            if len(cut if isinstance(cut, str) else cut[0]) <= 64:
                self._new[cut] = found
        return found

    def _spaced(self, text: str) -> str:
        """The text with its cuts parted by one space each; empty where that says not all."""
        if not text or not self.by_split or SPACE in text:
            return ""
        spaced = text.replace("\n", " \n")
        return spaced if "  " not in spaced and spaced[0] != " " and spaced[-1] != " " else ""

    def cuts(self, text: str) -> list:
        """Words that follow one space, or a line end and a word, as strings; all else as tuples of one string."""
        if not text:
            return []
        spaced = self._spaced(text)
        if spaced:
            return spaced.split(" ")
        return [(c,) for c in self.cut.findall(SPACE + text.replace(" ", SPACE))]

    def encode(self, text: str) -> list[int]:
        return [int(i) for c in self.cuts(text) for i in self.remembered(c)[1].split(",")]

    def _surface(self, ids: list[int]) -> str:
        if min(ids, default=0) > self.plain_from:
            return "".join([self.pieces[i] for i in ids]).replace(SPACE, " ")
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(_utf8(bytes(run)))
                run.clear()
            if i not in self.controls:
                out.append(" ⁇ " if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        if run:
            out.append(_utf8(bytes(run)))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the space that encoding put first goes."""
        ids = [i for i in ids if i not in self.controls]
        text = self._surface(ids)
        return text[1:] if ids and ids[0] not in self.byte_of and ids[0] != self.unknown and text.startswith(" ") else text

    def whole(self, text: str) -> tuple[int, str, str]:
        """(number of ids, ids joined by commas, decoded text); cuts end at whole characters, so they decode on their own."""
        if not text:
            return 0, "", ""
        get, new = self.remembered, self._new.get
        parts = [new(c) or get(c) for c in self.cuts(text)]
        count, joined, decoded, first = zip(*parts, strict=True)
        decoded = "".join(decoded)
        return sum(count), ",".join(joined), decoded[1:] if first[0] not in self.byte_of else decoded

    def digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, Callable[[], str]]]:
        """(number of ids, digest of ids joined by commas, digest of decoded text, ids joined by commas) of each text.

        A slice's words are told apart by Arrow, so that each different one is looked up once; what they become is laid out in the order of the texts.
        """
        a = size = 0
        for b, text in enumerate(texts):
            if b > a and size + len(text) > SLICE:
                yield from self._digests(texts[a:b])
                a, size = b, 0
            size += len(text)
        yield from self._digests(texts[a:])

    def _digests(self, texts: list[str]) -> Iterator[tuple[int, str, str, Callable[[], str]]]:
        spaced = [self._spaced(t) for t in texts]
        words = pc.split_pattern(pa.array([s for s in spaced if s], pa.large_string()), " ")
        each = words.flatten().dictionary_encode()
        distinct = _strings(each.dictionary)
        self._learn(distinct)
        get, new = self.remembered, self._new.get
        found = [new(c) or get(c) for c in distinct]
        count, joined, decoded, first = zip(*found, strict=True) if found else ((),) * 4
        at = each.indices.to_numpy()
        begin = words.offsets.to_numpy().astype(np.int64)
        count = np.concatenate([[0], np.cumsum(np.array(count, np.int64)[at])])[begin]
        ids, out = (_parts(pa.array(x, pa.large_string()).take(each.indices), begin) for x in ([f"{j}," for j in joined], decoded))
        k = 0
        for s, text in zip(spaced, texts, strict=True):
            if not s:
                n, whole, back = self.whole(text)
                yield n, hashlib.sha256(whole.encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), lambda whole=whole: whole
                continue
            own, back = ids(k)[:-1], out(k)
            if first[at[begin[k]]] not in self.byte_of:
                back = back[len(bytes(back[:4]).decode(errors="ignore")[:1].encode()) :]
            yield int(count[k + 1] - count[k]), hashlib.sha256(own).hexdigest(), hashlib.sha256(back).hexdigest(), lambda own=own: bytes(own).decode()
            k += 1


    def _learn(self, cuts: list[str]) -> None:
        """Remembers those words among cuts that are not yet known, many at a time; what is left is for remembered()."""
        new, old = self._new, self._old
        words = dict.fromkeys(c[:-1] if c[-1] in self.stops and c[:-1].isalpha() else c for c in cuts if c not in new and c not in old and c[0] != "\n")
        fresh = sorted((w for w in words if w not in new and w not in old and len(w) < LONGEST), key=len)
        for a in range(0, len(fresh), TOGETHER):
            some = fresh[a : a + TOGETHER]
            if len(self._new) + len(some) > REMEMBERED:
                self._old, self._new = self._new, {}
            self._new.update(self._merged(some))

    def _merged(self, cuts: list[str]) -> dict[str, tuple]:
        """What remembered() gives for words after a space, by the same agenda: in each round every word's best pair, of equal ones the first, is merged.

        Words with characters outside the vocabulary are left out. Symbols are linked by position, the last column stands for none.
        """
        if self._joins is None:
            joins = {self.ids[p[:k]] * (len(self.pieces) + 2) + self.ids[p[k:]]: (self.scores[p], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in self.ids and p[k:] in self.ids}
            keys = np.array(sorted(joins), np.int64)
            char = np.full(0x110000, -1, np.int32)
            for p, i in self.ids.items():
                if len(p) == 1:
                    char[ord(p)] = i
            texts = pa.array([f"{i}," for i in range(len(self.pieces))], pa.large_string())
            self._joins = keys, np.array([joins[k][0] for k in keys.tolist()], np.float64), np.array([joins[k][1] for k in keys.tolist()], np.int32), char, texts
        keys, scores, pieces, char, texts = self._joins
        if not len(keys):
            return {}

        def join(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            key = a.astype(np.int64) * (len(self.pieces) + 2) + b
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            return np.where(keys[at] == key, scores[at], -np.inf), pieces[at]

        size = np.array([len(c) + 1 for c in cuts])
        wide = int(size.max())
        flat = char[np.frombuffer("".join([SPACE + c for c in cuts]).encode("utf-32-le"), np.uint32)]
        alive = np.arange(wide) < size[:, None]
        symbol = np.full((len(cuts), wide + 1), -1, np.int32)
        symbol[:, :-1][alive] = flat
        whole = ~((symbol[:, :-1] < 0) & alive).any(1)
        symbol, alive, size = symbol[whole], alive[whole], size[whole]
        cuts = [c for c, w in zip(cuts, whole.tolist(), strict=True) if w]
        if not cuts:
            return {}
        rows = np.arange(len(cuts))
        after = np.tile(np.arange(1, wide + 2, dtype=np.int32), (len(cuts), 1))
        before = np.tile(np.arange(-1, wide, dtype=np.int32), (len(cuts), 1))
        after[rows, size - 1] = before[:, 0] = wide
        best = np.full((len(cuts), wide + 1), -np.inf)
        to = np.zeros((len(cuts), wide + 1), np.int32)
        best[:, :-1], to[:, :-1] = join(symbol[:, :-1], symbol[:, 1:])
        while len(rows):
            i = best[rows].argmax(1)
            more = best[rows, i] > -np.inf
            rows, i = rows[more], i[more]
            j = after[rows, i]
            symbol[rows, i], alive[rows, j], best[rows, j] = to[rows, i], False, -np.inf
            k, h = after[rows, j], before[rows, i]
            after[rows, i], before[rows, k] = k, i
            best[rows, i], to[rows, i] = join(symbol[rows, i], symbol[rows, k])
            best[rows, h], to[rows, h] = join(symbol[rows, h], symbol[rows, i])
        count = alive.sum(1)
        begin = np.concatenate([[0], np.cumsum(count)])
        ids = symbol[:, :-1][alive]
        said = texts.take(pa.array(ids))
        off = np.frombuffer(said.buffers()[1], np.int64)[begin].tolist()
        text = bytes(said.buffers()[2])[: off[-1]].decode()
        return {c: (n, text[x : y - 1], " " + c, f) for c, n, x, y, f in zip(cuts, count.tolist(), off, off[1:], ids[begin[:-1]].tolist(), strict=False)}


def _strings(words: pa.Array) -> list[str]:
    """Strings without spaces as a list; all are decoded at once, which takes a fifth of the time of to_pylist()."""
    if not len(words):
        return []
    off, data = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1], np.frombuffer(words.buffers()[2] or b"", np.uint8)
    return np.insert(data[off[0] : off[-1]], off[1:-1] - off[0], 32).tobytes().decode().split(" ")


def _parts(words: pa.Array, begin: np.ndarray) -> Callable[[int], memoryview]:
    """The bytes of each run of words, which lie one after the other."""
    off = np.frombuffer(words.buffers()[1] or bytes(8), np.int64)[words.offset + begin].tolist()
    data = memoryview(words.buffers()[2] or b"")
    return lambda k: data[off[k] : off[k + 1]]


def _utf8(data: bytes) -> str:
    """Each byte that starts no whole character becomes U+FFFD."""
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                pass
        else:
            out.append("�")
            i += 1
    return "".join(out)


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str | None = None) -> Vocabulary:
    path = path or model_path()
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


def encode_decode(docs: DataFrame, path: str | None = None, text: str = "text", ids: bool = False) -> DataFrame:
    """docs with n_tokens, ids_sha256 and decoded_sha256, and with ids, an array, if asked for.

    A column of docs that has one of these names is replaced.
    """
    text_batches(docs.sparkSession)
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    new += [T.StructField("ids", T.ArrayType(T.IntegerType()))] if ids else []
    own = [f for f in docs.schema.fields if f.name not in {x.name for x in new}]
    names = [f.name for f in own]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            n, a, b, lists = [], [], [], []
            for count, of_ids, of_text, joined in v.digests([s or "" for s in batch.column(batch.schema.names.index(text)).to_pylist()]):
                n.append(count)
                a.append(of_ids)
                b.append(of_text)
                if ids:
                    lists.append(np.array(joined().split(","), np.int32) if count else [])
            cols = [batch.column(batch.schema.names.index(x)) for x in names] + [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            cols += [pa.array(lists, pa.list_(pa.int32()))] if ids else []
            yield pa.RecordBatch.from_arrays(cols, [*names, *[x.name for x in new]])

    return docs.mapInArrow(work, T.StructType(own + new))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs).drop("text")


QUERIES = {"op9_sentencepiece": op9_sentencepiece}
ORACLES: dict[str, str] = {}
