"""BPE encoding as a bounded-lookahead streaming transducer, and its decoding."""

from __future__ import annotations

import codecs
import hashlib
import heapq
import itertools
import json
import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = "</w>"
#: Words whose encodings a worker keeps (up to twice as many for a while), and the longest such word; a constant bound on memory.
CACHE_WORDS, CACHE_CHARS = 250_000, 48
#: Base symbols read at a time beyond the lookahead, and characters of a text that are worked on at a time.
CHUNK, SECTION = 1024, 1 << 16
NEVER = 1 << 60


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: its own if printable in Latin-1, else the next from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


class WordBpe:
    """A word-level byte BPE: lower-cased words, the last symbol of each marked as an end."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        self.vocab: dict[str, int] = model["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["model"]["merges"]]
        self.ranks = {m: i for i, m in enumerate(merges)}
        self.text_of = {i: t for t, i in (self.vocab | self.special).items()}
        self.bytes_of = {i: t.encode() for i, t in self.text_of.items()}
        self.decimal = {i: str(i).encode() for i in self.text_of}
        self.symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(self.symbols)}
        self.lookahead = self.sufficient_lookahead(merges)
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.spaces = re.compile(r"[\t-\r \x85\xa0  -     　]+")
        self.letter, self.number = regex.compile(r"\p{L}"), regex.compile(r"\p{N}")
        self.controls = re.compile(r"[\x1c-\x1f]")

    @staticmethod
    def sufficient_lookahead(merges: list[tuple[str, str]]) -> int | None:
        """Base symbols after which what follows can't change a token any more; None if the list gives no bound.

        Unknown text to the right first acts by a merge (u, v) across the edge of
        what is known; its effect reaches one symbol further left only through a
        later merge (s, t) whose t begins with u. The longest such chain, measured
        in the left parts it swallows, bounds the reach. It holds for lists in
        which every part of a merge was made by an earlier one.
        """
        made: set[str] = set()
        for u, v in merges:
            for part in (u, v):
                if len(part.removesuffix(END)) > 1 and part not in made:
                    return None
            made.add(u + v)
        reach: dict[str, int] = {}
        longest = 0
        for u, v in reversed(merges):
            chain = len(u) + reach.get(u, 0)
            longest = max(longest, chain)
            for k in range(1, len(v) + 1):
                if reach.get(v[:k], 0) < chain:
                    reach[v[:k]] = chain
        return longest

    def merged(self, symbols: list[str]) -> list[str]:
        """All merges applied to ``symbols``, least rank first and leftmost among equals."""
        ranks = self.ranks
        if len(symbols) < 32:
            near = [ranks.get(p, NEVER) for p in zip(symbols, symbols[1:], strict=False)]
            while near and (best := min(near)) != NEVER:
                at = near.index(best)
                symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
                del near[at]
                if at < len(near):
                    near[at] = ranks.get((symbols[at], symbols[at + 1]), NEVER)
                if at:
                    near[at - 1] = ranks.get((symbols[at - 1], symbols[at]), NEVER)
            return symbols
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := self.ranks.get(p)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, (a, b) = heapq.heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # one of the two has merged meanwhile
            symbols[i], symbols[j] = a + b, ""
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := self.ranks.get(p := (symbols[i], symbols[after[i]]))) is not None:
                    heapq.heappush(heap, (r, i, p))
            if before[i] >= 0 and (r := self.ranks.get(p := (symbols[before[i]], symbols[i]))) is not None:
                heapq.heappush(heap, (r, before[i], p))
        return [s for s in symbols if s]

    def stream(self, symbols: Iterable[str]) -> Iterator[str]:
        """Tokens of one piece as soon as no later symbol can change them; holds CHUNK + lookahead symbols."""
        held: list[str] = []
        source = iter(symbols)
        ended = False
        while not ended:
            want = (self.lookahead or 0) + CHUNK
            while len(held) < want:
                s = next(source, None)
                if s is None:
                    ended = True
                    break
                held.append(s)
            if self.lookahead is None and not ended:
                held.extend(source)
                ended = True
            if ended:
                if held:
                    held[-1] += END
                    yield from self.merged(held)
                return
            stable, used = len(held) - self.lookahead, 0
            for token in self.merged(list(held)):
                if used + len(token) > stable:
                    break
                used += len(token)
                yield token
            if used:
                held = held[used:]
            else:
                held.extend(s for _, s in zip(range(CHUNK), source, strict=False))

    def normal(self, text: str) -> str:
        """NFC and lower case, letter by letter."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        return text.lower()

    def words(self, text: str) -> list[str]:
        """Normalised text, split at white space; every piece lies inside one of these words."""
        text = self.normal(text)
        if self.controls.search(text):
            return [w for w in self.spaces.split(text) if w]
        return text.split()

    def sections(self, text: str) -> Iterator[str]:
        """``text`` in parts of about SECTION characters, cut before white space; a longer run without any comes alone."""
        at = 0
        while at < len(text):
            if len(text) - at <= 2 * SECTION:
                end = len(text)
            else:
                gap = self.spaces.search(text, at + SECTION)
                end = gap.start() if gap else len(text)
                if end - at > 2 * SECTION:  # what stands before the long run is a part of its own
                    last = text.rfind(" ", at, at + SECTION)
                    end = last if last > at else end
            yield text[at:end]
            at = end

    def letters(self, text: str) -> Iterator[str]:
        """The normalised characters of a long text; it is normalised in parts, cut where no characters combine."""
        at = 0
        while at < len(text):
            end = min(len(text), at + SECTION)
            while end < len(text) and (unicodedata.category(text[end])[0] == "M" or "\u1160" <= text[end] <= "\u11ff"):
                end += 1
            yield from self.normal(text[at:end])
            at = end

    def numbered(self, characters: Iterator[str]) -> Iterator[tuple[int, str]]:
        """(number of its piece, character) for the characters of a text as they come: what ``pieces`` finds, two characters ahead."""
        kinds: dict[str, str] = {}
        kind = lambda c: kinds.get(c) or kinds.setdefault(c, "L" if self.letter.match(c) else "N" if self.number.match(c) else " " if self.spaces.match(c) else "O")
        ahead = deque(itertools.islice(characters, 3))
        piece, now, left = 0, "", 0
        while ahead:
            c = ahead.popleft()
            ahead.extend(itertools.islice(characters, 1))
            if left:  # inside a contraction
                left -= 1
            elif (k := kind(c)) == " ":
                now = ""
                continue
            elif k != now or k == "N":
                piece += 1
                now = k
                if c == "'":
                    two = "".join(itertools.islice(ahead, 2))
                    left = 2 if two in ("re", "ve", "ll") else 1 if two[:1] in ("s", "t", "m", "d") and two else 0
                    now = "" if left else now
            yield piece, c

    def of_word(self, word: str) -> Iterator[int]:
        """The ids of a normalised word as they become stable."""
        for piece in self.pieces.findall(word):
            for t in self.stream(self.symbols[b] for b in piece.encode()):
                yield self.vocab[t]

    def of_piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a short piece: one within the lookahead is stable at its end only, so it is read at once."""
        symbols = list(piece) if piece.isascii() and piece.isalpha() else [self.symbols[b] for b in piece.encode()]
        symbols[-1] += END
        return tuple([self.vocab[t] for t in self.merged(symbols)])

    def of_long(self, text: str) -> Iterator[int]:
        """The ids of a text that has long runs without white space, as they become stable; no run is ever held whole."""
        for _, characters in itertools.groupby(self.numbered(self.letters(text)), key=lambda x: x[0]):
            for t in self.stream(self.symbols[b] for _, c in characters for b in c.encode()):
                yield self.vocab[t]

    def parts(self, text: str) -> Iterator[str]:
        """Special tokens and what stands between them, in order."""
        at = 0
        for m in self.split_special.finditer(text):
            yield text[at : m.start()]
            yield m[0]
            at = m.end()
        yield text[at:] if at else text

    def blocks(self, text: str, kept: Kept) -> Iterator[list[int]]:
        """The ids of ``text``, some thousands at a time: words of up to CACHE_CHARS by way of ``kept``, longer ones as their tokens become stable."""
        for part in self.parts(text):
            if part in self.special:
                yield [self.special[part]]
                continue
            for section in self.sections(part):
                if len(section) > 2 * SECTION:
                    yield from batched(self.of_long(section))
                    continue
                words = self.words(section)
                if words and max(map(len, words)) > CACHE_CHARS:
                    yield from batched(i for w in words for i in (kept[w] if len(w) <= CACHE_CHARS else self.of_word(w)))
                else:
                    yield list(itertools.chain.from_iterable(map(kept.__getitem__, words)))

    def encode(self, text: str) -> Iterator[int]:
        """The ids of ``text``, one by one."""
        return itertools.chain.from_iterable(self.blocks(text, Kept(self)))

    def token_texts(self, ids: Iterable[int]) -> str:
        """The library's rendering without a decoder: token texts joined by a space."""
        return " ".join(self.text_of[i] for i in ids)

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """Text in pieces as ids arrive: a UTF-8 state machine over the tokens' bytes; an end of word becomes a space."""
        machine = codecs.getincrementaldecoder("utf-8")("replace")
        for i in ids:
            token = self.text_of[i]
            if token in self.special:
                yield machine.decode(b"", True) + token
                machine.reset()
                continue
            body = token.removesuffix(END)
            yield machine.decode(bytes(self.byte_of[c] for c in body)) + (" " if body != token else "")
        yield machine.decode(b"", True)


class Renderer:
    """Ids to the text that the library's decoding gives, as they arrive: tokens, joined by spaces, as bytes that a UTF-8
    state machine turns into characters."""

    def __init__(self, bpe: WordBpe):
        self.bytes_of = bpe.bytes_of
        self.machine = codecs.getincrementaldecoder("utf-8")("strict")
        self.first = True

    def feed(self, ids: list[int]) -> str:
        if not ids:
            return ""
        data = b" ".join(map(self.bytes_of.__getitem__, ids))
        data, self.first = data if self.first else b" " + data, False
        return self.machine.decode(data)

    def end(self) -> str:
        return self.machine.decode(b"", True)


class Kept(dict):
    """Short word -> its ids; its pieces are kept as words of their own. Of what is there when it is full, the words that come
    again before it next is stay."""

    def __init__(self, bpe: WordBpe):
        self.bpe, self.old = bpe, {}

    def __missing__(self, word: str) -> tuple[int, ...]:
        ids = self.old.pop(word, None)
        if ids is None:
            ids = self.ids(word)
        if len(self) >= CACHE_WORDS:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def ids(self, word: str) -> tuple[int, ...]:
        pieces = [word] if word.isascii() and word.isalpha() else self.bpe.pieces.findall(word)
        return self.bpe.of_piece(word) if pieces == [word] else tuple(itertools.chain.from_iterable([self[p] for p in pieces]))


def batched(ids: Iterable[int]) -> Iterator[list[int]]:
    ids = iter(ids)
    while some := list(itertools.islice(ids, 4096)):
        yield some


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


@lru_cache(maxsize=2)
def kept_words(path: str) -> Kept:
    """The worker's own cache; tasks that follow each other there share it."""
    return Kept(word_bpe(path))


def digest(bpe: WordBpe, text: str, kept: Kept) -> tuple[int, str, str]:
    """How many ids ``text`` has, the digest of the ids and that of what they decode to: both are fed as ids become stable."""
    n, of_ids, of_text, renderer = 0, hashlib.sha256(), hashlib.sha256(), Renderer(bpe)
    for ids in bpe.blocks(text, kept):
        if ids:
            of_ids.update((b" " if n else b"") + b" ".join(map(bpe.decimal.__getitem__, ids)))
            of_text.update(renderer.feed(ids).encode())
            n += len(ids)
    of_text.update(renderer.end().encode())
    return n, of_ids.hexdigest(), of_text.hexdigest()


def digests(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, kept = word_bpe(path), kept_words(path)
        for batch in batches:
            n, a, b = list(zip(*[digest(bpe, text.as_py(), kept) for text in batch.column("text")], strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def bpe_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for each row of ``docs`` (doc_id, text).

    Ids are those of the vocabulary file at ``path`` without added tokens, and
    decoding renders them as that file does. Ids go into their digest and through the
    decoder as they become stable, so a task holds a text, some thousand ids and a
    bounded cache of short words' ids. A null or empty text has no ids (the digest of
    nothing); repeated rows give a row each; an empty table gives an empty result;
    other columns are ignored.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(digests(path), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int) for each row: the encoding itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([list(bpe.encode(t.as_py())) for t in batch.column("text")], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text for each row of ``encoded`` (doc_id, ids), through the byte-to-text machine."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(["".join(bpe.decode(x.as_py() or ())) for x in batch.column("ids")], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")
