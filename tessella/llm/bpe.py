"""Byte-pair encoding of words by backtracking, and decoding by an offset table.

The merges of a word need not be replayed. From left to right the encoder takes
the longest token that starts at each place, as an Aho-Corasick automaton over
the reversed tokens gives them for all places in one pass. A token may stand
after the one before it if no merge joins the two before both are whole: whether
a pair is compatible follows from how its tokens were merged, and is kept in a
table. If it may not, the next shorter token is tried; if none is left, the place
is a dead end for good and the token before it is shortened. The one tokenisation
whose neighbours are all compatible is that of the merges, and each place is a
dead end once at most, so the time is linear in the word.

Words are found as the vocabulary's file says: special tokens in the raw text
first, then normalisation and the split. Text of the scripts whose characters no
version of Unicode has changed is split here; other text by the library, since
classes of newly assigned characters differ between versions of Unicode.
Tokens are over an alphabet of byte signs, with the last sign of a word marked.

The file is read once on the driver and sent to the workers (some megabytes).

Cases: null and empty texts, and those of white space, have no tokens; a word of
any length is encoded whole; repeated rows come out one by one; ids outside the
vocabulary, and nulls, are skipped in decoding; null ids decode to the empty text;
an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import arrays as A
from tessella.session import ship

#: A worker keeps the tokens of 1 to 2 times so many words of late, the longest of them, and so many pairs.
KEPT_WORDS, KEPT_LENGTH, KEPT_PAIRS = 250_000, 64, 1_000_000
#: Distance of a sign at the end of a word from the plain sign; byte signs are below.
LAST = 0x1000
#: Bytes of text whose tokens are handed on at a time.
SLICE = 1 << 20

#: The split of the vocabularies whose words are split here.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Latin, Greek and Cyrillic with their marks, punctuation, currency, arrows, kana, ideographs, syllables.
SETTLED = r"\u0000-\u0527\u1E00-\u1FFF\u2000-\u2064\u20A0-\u20BF\u2190-\u21FF\u3001-\u3029\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FEF\uAC00-\uD7A3"


def byte_signs() -> list[str]:
    """The sign of each byte: itself if it prints, else the next free one from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return [chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)]


class Merges:
    """Which tokenisation of a word a list of merges leaves. Tokens are numbered as in the vocabulary."""

    def __init__(self, vocabulary: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        def signs(token: str) -> str:
            return token if not suffix or not token.endswith(suffix) else token[: -len(suffix) - 1] + chr(ord(token[-len(suffix) - 1]) + LAST)

        top = max(vocabulary.values()) + 1
        #: Of the token: its length in signs, the merge that makes it (-1: none), and the halves that it joins.
        self.length, self.born, self.halves = [0] * top, [-1] * top, [(-1, -1)] * top
        self.joined: dict[tuple[int, int], int] = {}
        self.known: dict[tuple[int, int], bool] = {}
        spelled = {signs(t): i for t, i in vocabulary.items()}
        if len(spelled) < len(vocabulary):
            raise ValueError("two tokens of the vocabulary are spelled alike")
        for t, i in spelled.items():
            self.length[i] = len(t)
        for rank, (a, b) in enumerate(merges):
            pair = vocabulary[a], vocabulary[b]
            made = vocabulary[a + b]
            if self.born[made] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.joined[pair], self.born[made], self.halves[made] = rank, rank, pair
        # a token whose own merges leave something else never comes out
        real = [self.length[i] == 1 for i in range(top)]
        for a, b in merges:
            i = vocabulary[a + b]
            x, y = self.halves[i]
            real[i] = real[x] and real[y] and self._side_by_side(x, y, self.born[i])
        #: The longest real token that is a proper prefix of the token; -1: none.
        self.shorter = [-1] * top
        self.automaton = ahocorasick.Automaton()
        for t, i in spelled.items():
            if real[i]:
                self.shorter[i] = next((j for n in range(len(t) - 1, 0, -1) if (j := spelled.get(t[:n], -1)) >= 0 and real[j]), -1)
                self.automaton.add_word(t[::-1], i)
        self.automaton.make_automaton()

    def _side_by_side(self, a: int, b: int, until: float) -> bool:
        """No merge before ``until`` joins the end of ``a`` to the start of ``b``.

        The merges of both are undone, last one first; at each point the pieces at
        the border stood side by side until the merge just undone. Of equal merges
        the left one comes first.
        """
        while True:
            if self.joined.get((a, b), until) < until:
                return False
            if self.born[a] > self.born[b]:
                until, a = self.born[a], self.halves[a][1]
            elif self.born[b] >= 0:
                until, b = self.born[b] + 0.5, self.halves[b][0]
            else:
                return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether ``b`` may stand after ``a``, from the table or anew."""
        if len(self.known) >= KEPT_PAIRS:
            self.known.clear()
        known = self.known[a, b] = self._side_by_side(a, b, float("inf"))
        return known

    def encode(self, word: str) -> array:
        """Tokens of one word in signs, the last of them marked."""
        n = len(word)
        longest = array("i", [-1]) * n
        for end, token in self.automaton.iter(word[::-1]):  # the longest of a place first
            if longest[n - 1 - end] < 0:
                longest[n - 1 - end] = token
        lengths, shorter, known = self.length, self.shorter, self.known
        out = array("i")
        dead: set[int] = set()
        at, before, token = 0, -1, longest[0]
        while at < n:
            while token >= 0:
                to = at + lengths[token]
                if to not in dead:
                    if before < 0:
                        break
                    fits = known.get((before, token))
                    if self.compatible(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                out.append(token)
                at, before = to, token
                token = longest[at] if at < n else -1
            elif before >= 0:
                dead.add(at)
                at -= lengths[before]
                token = shorter[out.pop()]
                before = out[-1] if out else -1
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out


class Vocabulary:
    """A tokenizer file: special tokens, words, merges, and the spelling of each id."""

    def __init__(self, source: bytes) -> None:
        spec = json.loads(source)
        model = spec["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("dropout") or model.get("byte_fallback") or model.get("ignore_merges") or spec.get("decoder"):
            raise ValueError("not a BPE of words without a decoder")
        suffix = model.get("end_of_word_suffix") or ""
        self._model, self.suffix = model, bool(suffix)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError("special tokens are plain strings of the raw text")
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        plain = spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": []}
        library = tokenizers.Tokenizer.from_str(json.dumps(plain))
        self.normalizer, self.split = library.normalizer, library.pre_tokenizer
        self.own = self.splits_here(spec)
        self.odd, self.word = regex.compile(f"[^{SETTLED}]"), regex.compile(SPLIT)
        self.signs = {b: s for b, s in enumerate(byte_signs())}
        #: Words of late and those before them, as they are and in byte signs.
        self.kept: list[dict[str, array]] = [{}, {}]
        self.older: list[dict[str, array]] = [{}, {}]
        spelled = {i: t for t, i in [*model["vocab"].items(), *self.special.items()]}
        texts = [(spelled[i] + " ").encode() if i in spelled else b"" for i in range(max(spelled) + 1)]
        self.bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)

    @cached_property
    def merges(self) -> Merges:
        """Only encoding needs it."""
        model = self.__dict__.pop("_model")
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        return Merges(model["vocab"], pairs, model.get("end_of_word_suffix") or "")

    @staticmethod
    def splits_here(spec: dict) -> bool:
        normal, split = (spec.get("normalizer") or {}).get("normalizers", []), (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        return (
            [x["type"] for x in normal] == NORMALIZERS
            and normal[1]["pattern"] == {"Regex": "\\s+"}
            and normal[1]["content"] == " "
            and [x["type"] for x in split] == ["Split", "ByteLevel"]
            and split[0]["pattern"] == {"Regex": SPLIT}
            and (split[0]["behavior"], split[0]["invert"]) == ("Removed", True)
            and not (split[1]["add_prefix_space"] or split[1]["use_regex"])
        )

    def words(self, text: str) -> tuple[list[str], bool]:
        """Words of text without special tokens, and whether they are in byte signs already."""
        if self.own and not self.odd.search(text):
            # sign by sign, so that a sigma at the end of a word is like any other
            return self.word.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()), False
        return [w for w, _ in self.split.pre_tokenize_str(self.normalizer.normalize_str(text))], True

    def tokens(self, word: str, in_signs: bool) -> array:
        """Tokens of a word that is not among those kept of late."""
        found = self.older[in_signs].get(word)
        if found is None:
            signs = word if in_signs else word.encode().decode("latin-1").translate(self.signs)
            found = self.merges.encode(signs[:-1] + chr(ord(signs[-1]) + LAST) if self.suffix else signs)
        if len(word) <= KEPT_LENGTH:
            if len(self.kept[in_signs]) >= KEPT_WORDS:
                self.older[in_signs], self.kept[in_signs] = self.kept[in_signs], {}
            self.kept[in_signs][word] = found
        return found

    def encode(self, text: str) -> array:
        out = array("i")
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                words, in_signs = self.words(part)
                for word in words:
                    out.extend(self.kept[in_signs].get(word) or self.tokens(word, in_signs))
        return out

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of runs of ids: the tokens' spellings with a blank between."""
        top = len(self.offsets) - 1
        good = (ids >= 0) & (ids < top)
        good[good] = self.offsets[ids[good] + 1] > self.offsets[ids[good]]
        doc = np.repeat(np.arange(len(counts)), counts)[good]
        ids = ids[good]
        size = self.offsets[ids + 1] - self.offsets[ids]
        flat = self.bytes[A.ranges(self.offsets[ids], size)]
        each = np.bincount(doc, weights=size, minlength=len(counts)).astype(np.int64)
        ends = np.cumsum(each)
        keep = np.ones(len(flat), bool)
        keep[ends[each > 0] - 1] = False  # the blank behind the last
        return A.binary_rows(flat[keep], each - (each > 0)).view(pa.string())


#: The vocabulary that this process read last, by its bytes.
_last: tuple[bytes, Vocabulary] | None = None


def loaded(source: bytes) -> Vocabulary:
    global _last
    if _last is None or _last[0] != source:
        _last = source, Vocabulary(source)
    return _last[1]


def encode(docs: DataFrame, path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each row; ``path`` is the tokenizer file on the driver's machine."""
    spark = docs.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(shared.value)
        for part, _, _ in A.chunks(batches, size=SLICE):
            counts, flat = [0], array("i")
            for text in part.column(1):
                ids = vocabulary.encode(text.as_py() or "")
                flat.extend(ids)
                counts.append(len(flat))
            values = pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(counts, pa.int32()), values)], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, ids and text: what the ids spell."""
    spark = encoded.sparkSession
    ship(spark)
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = loaded(shared.value)
        for batch in batches:
            counts = np.asarray(batch.column(1).value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            at, total = 0, np.cumsum(counts)
            while at < batch.num_rows:  # slices of about SLICE ids
                to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE, side="right")))
                part = batch.slice(at, to - at)
                ids = part.column(1).flatten().fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), vocabulary.decode(ids, counts[at:to])], names=["doc_id", "ids", "text"])
                at = to

    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, text string")
