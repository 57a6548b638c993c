"""Token counts by compiled finite-state transducers.

Two transducers replace the tokenizer's string rewriting. The first runs over characters and cuts a text
into pre-tokens; it is a table over nine states, with an output bit where a pre-token starts (one character
late where that needs a look ahead). Text is cut into chunks of equal length; each chunk is a map from state
to state, all maps are computed side by side, and a parallel prefix scan composes them, which gives every
chunk its entry state. The second runs over the bytes of a pre-token. Its states know the encoding of every
prefix that can still matter, and each transition carries the number of tokens it adds. States and transitions
are compiled from the vocabulary's merges when first needed, and remembered.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_schema, kept_in_worker, table, text_slices

LIMIT = 2048
#: Characters of a chunk of the prefix scan.
CHUNK = 256
#: States, pre-tokens and pairs of tokens a worker remembers; beyond, they are worked out anew.
STATES, REMEMBERED, PAIRS = 120_000, 400_000, 150_000
#: Text cut at once; what is kept for each of its characters takes some 25 times as much.
SLICE = 1 << 20

# Character classes.
OTHER, SPACE, LETTER, DIGIT, QUOTE, SINGLE, R, V, L, E, UNKNOWN = range(11)
# States: after space, in letters, after a digit, in signs, after a leading quote, after quote and r, v or
# l, after a whole contraction ('s 't 'm 'd 're 've 'll).
GAP, WORD, NUMBER, SIGNS, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, DONE = range(9)
STARTS, STARTED = 1, 2
WHITE = "\t\n\v\f\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def pretoken_tables() -> tuple[np.ndarray, np.ndarray]:
    """Next state and output bits by state and class.

    STARTS marks the character read as the first of a pre-token, STARTED the one before it.
    """
    step, out = np.zeros((9, 10), np.uint8), np.zeros((9, 10), np.uint8)
    fresh = {OTHER: SIGNS, SPACE: GAP, DIGIT: NUMBER, QUOTE: QUOTED} | dict.fromkeys((LETTER, SINGLE, R, V, L, E), WORD)
    waiting = {QUOTED_R: E, QUOTED_V: E, QUOTED_L: L}
    for state in range(9):
        for kind in range(10):
            letter = kind in (LETTER, SINGLE, R, V, L, E)
            to, mark = fresh[kind], 0 if kind == SPACE else STARTS
            if (state == WORD or state in waiting) and letter:
                to, mark = WORD, 0
            if state in waiting:
                if kind == waiting[state]:
                    to, mark = DONE, 0
                else:
                    mark |= STARTED
            if state in (SIGNS, QUOTED) and kind in (OTHER, QUOTE):
                to, mark = SIGNS, 0
            if state == QUOTED and kind in (SINGLE, R, V, L):
                to, mark = {SINGLE: DONE, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L}[kind], 0
            step[state, kind], out[state, kind] = to, mark
    return step, out


class Library:
    """What the tokenizer's own library says of a character.

    Its Unicode tables decide, not this Python's, which may be older or differ from worker to worker.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(vocabulary)
        self.normal = tokenizer.normalizer.normalize_str
        self.cut = tokenizer.pre_tokenizer.pre_tokenize_str

    def kind(self, char: str) -> int:
        """Space, letter, digit or other, by how text around the character is cut."""
        pieces = len(self.cut(f"a{char}{char}a"))
        # Spaces go, letters join, digits stand alone, others join each other.
        return {1: LETTER, 3: OTHER, 4: DIGIT}.get(pieces, SPACE)

    def differs(self, char: str) -> bool:
        """Whether this Python lower-cases or composes the character otherwise, or doesn't know it."""
        return char not in WHITE and (unicodedata.category(char) == "Cn" or plain_normal(char) != self.normal(char))


def plain_normal(text: str) -> str:
    """Composed and lower case; a capital sigma has one lower case here, whatever follows."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


class Classes:
    """Class of every code point, and whether Python knows it otherwise, filled in as met."""

    def __init__(self, library: Library):
        self.library = library
        self.known = np.full(0x110000, UNKNOWN, np.uint8)
        self.odd = np.full(0x110000, UNKNOWN, np.uint8)

    def kind(self, char: str) -> int:
        if char in WHITE:
            return SPACE
        if char in "stmd":
            return SINGLE
        if char in "'rvle":
            return {"'": QUOTE, "r": R, "v": V, "l": L, "e": E}[char]
        return self.library.kind(char)

    def is_odd(self, text: str) -> bool:
        """Whether the library must lower-case a text itself."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        found = self.odd[codes]
        if (found == UNKNOWN).any():
            for code in np.unique(codes[found == UNKNOWN]).tolist():
                self.odd[code] = code > 0x7F and self.library.differs(chr(code))
            found = self.odd[codes]
        return bool(found.any())

    def of(self, codes: np.ndarray) -> np.ndarray:
        kinds = self.known[codes]
        if (kinds == UNKNOWN).any():
            for code in np.unique(codes[kinds == UNKNOWN]).tolist():
                self.known[code] = self.kind(chr(code))
            kinds = self.known[codes]
        return kinds


def scan_states(kinds: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Entry state of every chunk of class rows (chunks, CHUNK), starting in GAP."""
    flat, width = step.ravel(), step.shape[1]
    maps = np.tile(np.arange(step.shape[0], dtype=np.uint8), (len(kinds), 1))
    for column in kinds.T:
        maps = flat[maps * np.uint8(width) + column[:, None]]
    reach = 1
    while reach < len(maps):  # maps[i] becomes the map of all chunks up to i
        maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach], axis=1)
        reach *= 2
    return np.concatenate(([GAP], maps[:-1, GAP])).astype(np.uint8)


def pretoken_spans(kinds: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every pre-token of a character sequence that ends in a space."""
    step, out = tables
    n = len(kinds)
    rows = np.concatenate((kinds, np.full(-n % CHUNK, SPACE, np.uint8))).reshape(-1, CHUNK)
    state = scan_states(rows, step)
    marks = np.empty_like(rows)
    flat, signs, width = step.ravel(), out.ravel(), np.uint8(step.shape[1])
    for k in range(CHUNK):
        at = state * width + rows[:, k]
        marks[:, k] = signs[at]
        state = flat[at]
    marks = marks.ravel()[:n]
    starts = (marks & STARTS) > 0
    starts[:-1] |= (marks[1:] & STARTED) > 0
    events = np.flatnonzero(starts | (kinds == SPACE))
    first = starts[events]
    ends = np.append(events[1:], n)
    return events[first], ends[first]


class Merges:
    """The vocabulary's merges, and which tokens may stand beside each other."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            model = json.load(file)["model"]
        self.end = model["end_of_word_suffix"]
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.ranks = {tuple(pair): i for i, pair in enumerate(pairs)}
        #: Every token and prefix by itself, so that what is remembered shares one string.
        self.tokens = {token: token for token in model["vocab"]}
        bare = {t.removesuffix(self.end) for t in self.tokens}
        self.longest = max(map(len, bare))
        self.prefixes = {t[:i]: t[:i] for t in bare for i in range(1, len(t) + 1)}
        self.agree: dict[tuple[str, str], bool] = {}
        self.whole: dict[str, bool] = {}

    def symbols(self, token: str) -> list[str]:
        if token.endswith(self.end) and len(token) > len(self.end):
            bare = token[: -len(self.end)]
            return [*bare[:-1], bare[-1] + self.end]
        return list(token)

    def encode(self, parts: list[str]) -> list[str]:
        """The merges applied in order of rank, from the left."""
        while len(parts) > 1:
            rank, at = min((self.ranks.get(pair, 1 << 30), i) for i, pair in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 30:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def stands(self, token: str) -> bool:
        """Whether the token is in the vocabulary and encodes to itself."""
        if token not in self.tokens:
            return False
        found = self.whole.get(token)
        if found is None:
            found = self.whole[self.tokens[token]] = self.encode(self.symbols(token)) == [token]
        return found

    def beside(self, left: str, right: str) -> bool:
        """Whether the two tokens stay as they are beside each other."""
        key = (left, right)
        found = self.agree.get(key)
        if found is None:
            if len(self.agree) >= PAIRS:
                self.agree.clear()
            found = self.agree[left, self.tokens.get(right, right)] = self.encode(self.symbols(left) + self.symbols(right)) == [left, right]
        return found


#: The transitions of a state that has none yet.
NONE: dict = {}


class CountTransducer:
    """Counts the tokens of a pre-token, byte by byte.

    A state holds the longest tail of the input that some token begins with, and for every cut in that tail
    from which a token can still grow, the last token of the encoding up to the cut and its token count
    relative to the present one. Encodings
    of prefixes are unique, and a sequence of tokens is an encoding if its neighbours agree, so the last
    token of a longer prefix follows from the state alone. The last byte of a word is a symbol of its own
    and has transitions of its own.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.reset()

    def reset(self) -> None:
        start = ("", ((0, None, 0),))
        self.numbers = {start: 0}
        self.states = [start]
        #: States without transitions share one empty dictionary.
        self.inner: list[dict[str, tuple[int, int]]] = [NONE]
        self.last: list[dict[str, int]] = [NONE]

    def reached(self, state: int, char: str, suffix: str) -> tuple[str, int]:
        """Last token and added count when ``char`` (with ``suffix``) is read."""
        tail, cuts = self.states[state]
        text = tail + char + suffix
        stands, beside = self.merges.stands, self.merges.beside
        for cut, token, count in cuts:
            grown = text[cut:]
            if stands(grown) and (token is None or beside(token, grown)):
                return self.merges.tokens[grown], count + 1
        raise ValueError(f"no token ends at {text!r}")

    def compile(self, state: int, char: str) -> tuple[int, int]:
        tail, cuts = self.states[state]
        token, added = self.reached(state, char, "")
        text = tail + char
        prefixes = self.merges.prefixes
        open_ = [(cut, last, count - added) for cut, last, count in cuts if text[cut:] in prefixes]
        first = open_[0][0] if open_ else len(text)
        tail = prefixes.get(text[first:], "")
        key = (tail, (*((cut - first, last, count) for cut, last, count in open_), (len(text) - first, token, 0)))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.inner.append(NONE)
            self.last.append(NONE)
        found = (number, added)
        self.inner[state] = self.inner[state] or {}
        self.inner[state][char] = found
        return found

    def count(self, word: str) -> int:
        if len(self.states) > STATES:
            self.reset()
        state, total = 0, 0
        inner, last = self.inner, self.last
        for char in word[:-1]:
            state, added = inner[state].get(char) or self.compile(state, char)
            total += added
        added = last[state].get(word[-1])
        if added is None:
            added = self.reached(state, word[-1], self.merges.end)[1]
            last[state] = last[state] or {}
            last[state][word[-1]] = added
        return total + added


def byte_alphabet() -> dict[int, str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Counts(dict):
    """Token counts of pre-tokens, remembered."""

    def __init__(self, transducer: CountTransducer):
        super().__init__()
        self.transducer = transducer
        self.letters = {b: c for b, c in byte_alphabet().items()}

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        spelled = word if word.isascii() and word.isprintable() else word.encode().decode("latin-1").translate(self.letters)
        value = self[word] = self.transducer.count(spelled)
        return value


class TokenCounter:
    """Counts of whole texts under a lower-casing word-level vocabulary file."""

    def __init__(self, vocabulary: str):
        with open(vocabulary, encoding="utf-8") as file:
            added = [token["content"] for token in json.load(file)["added_tokens"]]
        self.special = sorted(added, key=len, reverse=True)
        self.library = Library(vocabulary)
        self.classes, self.tables = Classes(self.library), pretoken_tables()
        self.counts = Counts(CountTransducer(Merges(vocabulary)))

    def segments(self, text: str) -> tuple[int, list[str]]:
        """Special strings found, and the parts between them."""
        parts = [text]
        for token in self.special:
            if token in text:
                parts = [piece for part in parts for piece in part.split(token)]
        return len(parts) - 1, parts

    def normal(self, text: str) -> str:
        """Composed and lower case, as the library has it."""
        if text.isascii() or not self.classes.is_odd(text):
            return plain_normal(text)
        return self.library.normal(text)

    def of(self, texts: list[str]) -> np.ndarray:
        totals, pieces, sizes = np.zeros(len(texts), np.int64), [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            totals[i], parts = self.segments(text)
            own = [self.normal(part) + " " for part in parts]
            pieces += own
            sizes[i] = sum(map(len, own))
        joined = "".join(pieces)
        kinds = self.classes.of(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
        starts, ends = pretoken_spans(kinds, self.tables)
        words = (joined[a:b] for a, b in zip(starts.tolist(), ends.tolist()))
        counts = np.fromiter(map(self.counts.__getitem__, words), np.int64, len(starts))
        sums = np.concatenate(([0], np.cumsum(counts)))
        limits = np.searchsorted(starts, np.cumsum(sizes))
        return totals + np.diff(sums[np.concatenate(([0], limits))])


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row, without begin, end or padding tokens.

    Null and empty texts count zero; special strings inside texts are one token each. Repeated rows stay
    rows, null doc_ids stay null; other columns aren't read; an empty table gives an empty result.
    """
    kind = "doc_id long, n_bytes long, n_tokens long"
    schema = arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = kept_in_worker(("token counter", vocabulary), lambda: TokenCounter(vocabulary))
        for part in text_slices(batches, limit=SLICE):
            sizes = pa.compute.fill_null(pa.compute.binary_length(part["text"]), 0).cast(pa.int64())
            counts = counter.of([text or "" for text in part["text"].to_pylist()])
            yield pa.record_batch([part["doc_id"].cast(pa.int64()), sizes, pa.array(counts)], schema=schema)

    return docs.select("doc_id", "text").mapInArrow(run, kind)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document, and whether it has more than 2048 tokens."""
    import public_tokenizers

    counted = count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return counted.withColumn("over_limit", F.col("n_tokens") > LIMIT)
