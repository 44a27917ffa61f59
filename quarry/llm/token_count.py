"""Operator 6: token counts by finite-state tokenizer compilation.

Two deterministic machines count the tokens of a text without building them.

* The *splitter* reads character classes. Its states say what the current pre-token may still become, and its transitions
  say where pre-tokens begin. A text is cut into chunks; every chunk gets a state map (end state for each start state),
  the maps are composed by a parallel prefix scan, and with its true start state each chunk then emits its boundaries.
* The *transducer* reads the bytes of one pre-token. Each transition carries the change of the emitted-token count. Its
  states are the open vocabulary prefixes with the last token and the count before each of them: byte-pair merging gives
  every prefix of a word exactly one last token, the one whose pair with the token before it merging would leave apart.
  States and transitions are compiled on first use and dropped when a bound is reached.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from quarry.llm._base import documents, text_chunks

COUNTS = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
#: Character classes of the splitter.
SPACE, LETTER, NUMBER, OTHER, QUOTE, ONE, ERE, E_, ELL = range(9)
#: States of the splitter: between pre-tokens, in letters, in other characters, after a first quote, after 'r or 'v, after 'l.
FREE, IN_LETTERS, IN_OTHER, AFTER_QUOTE, AFTER_ERE, AFTER_ELL = range(6)
#: What a transition emits: a pre-token begins here; one begins a character earlier (known only now); both.
NOTHING, HERE, BEFORE, BOTH = range(4)
CHUNK = 512
#: Characters of the longest words that are remembered.
KEPT = 64


def splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and emission by (class, state), for 's|'t|'re|'ve|'m|'ll|'d|letters|one number|others."""
    nxt, out = np.zeros((9, 6), np.uint8), np.zeros((9, 6), np.uint8)
    letters = (LETTER, ONE, ERE, E_, ELL)
    for state in range(6):
        late = BEFORE if state in (AFTER_ERE, AFTER_ELL) else NOTHING  # 'r or 'l was a quote and then letters
        for c in range(9):
            s, o = FREE, late
            if c == NUMBER:
                s, o = FREE, late | HERE
            elif c in letters:
                inside = state == IN_LETTERS or late
                s, o = IN_LETTERS, (late if inside else HERE)
                if state == AFTER_QUOTE:
                    s, o = {ONE: (FREE, NOTHING), ERE: (AFTER_ERE, NOTHING), ELL: (AFTER_ELL, NOTHING)}.get(c, (IN_LETTERS, HERE))
                elif state == AFTER_ERE and c == E_ or state == AFTER_ELL and c == ELL:
                    s, o = FREE, NOTHING
            elif c in (OTHER, QUOTE):
                if state in (IN_OTHER, AFTER_QUOTE):
                    s, o = IN_OTHER, NOTHING
                else:
                    s, o = (AFTER_QUOTE if c == QUOTE else IN_OTHER), late | HERE
            nxt[c, state], out[c, state] = s, o
    return nxt, out


@lru_cache(2)
def classes(path: str) -> np.ndarray:
    """The class of every code point. Letters and numbers are those that the library's own pattern takes for such: its Unicode
    version may be another than that of Python's modules."""
    from tokenizers import Tokenizer

    table = np.full(0x110000, OTHER, np.uint8)
    named = regex.compile(r"[\p{L}\p{N}]")
    split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000 and named.match(chr(c))] + [c for c in range(0x80) if chr(c).isalnum()]
    for lo in range(0, len(points), 20_000):
        some = points[lo : lo + 20_000]
        # of "ac!" a letter c gives "ac" and "!", a number "a", c and "!", anything else "a" and "c!"
        lengths = [e - s for _, (s, e) in split(" ".join(f"a{chr(c)}!" for c in some))]
        at = 0
        for c in some:
            n = 2 if lengths[at] == 2 or lengths[at + 1] == 2 else 3
            table[c] = LETTER if lengths[at] == 2 else NUMBER if n == 3 else OTHER
            at += n
    for c in range(0x3001):
        if regex.match(r"\s", chr(c)):
            table[c] = SPACE
    table[[0x1C, 0x1D, 0x1E, 0x1F]] = OTHER  # white space to Python's modules only
    for c, chars in ((QUOTE, "'"), (ONE, "stmd"), (ERE, "rv"), (E_, "e"), (ELL, "l")):
        table[[ord(x) for x in chars]] = c
    return table


def boundaries(kinds: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin, for the classes of a text: state maps of chunks, prefix scan, emission."""
    nxt, out = splitter()
    n = len(kinds)
    rows = -(-max(n, 1) // CHUNK)
    grid = np.full(rows * CHUNK, SPACE, np.uint8)
    grid[:n] = kinds
    columns = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    flat_next, flat_out = nxt.reshape(-1), out.reshape(-1)
    maps = np.tile(np.arange(6, dtype=np.uint8), (rows, 1))
    for column in columns:
        maps = flat_next[(column.astype(np.int16) * 6)[:, None] + maps]
    step = 1  # inclusive scan: after it, maps[i] leads from the text's start through chunk i
    while step < rows:
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step], axis=1)
        step *= 2
    state = np.concatenate([[FREE], maps[:-1, FREE]]).astype(np.int16)
    emitted = np.empty((CHUNK, rows), np.uint8)
    for i, column in enumerate(columns):
        at = column.astype(np.int16) * 6 + state
        emitted[i], state = flat_out[at], flat_next[at].astype(np.int16)
    flags = emitted.T.reshape(-1)
    begins = (flags & HERE).astype(bool)
    begins[:-1] |= (flags[1:] & BEFORE).astype(bool)
    return np.flatnonzero(begins[:n])


class Transducer:
    """Counts the tokens of one pre-token of a byte-pair vocabulary with word ends."""

    def __init__(self, vocab: dict[str, int], merges: list, end: str, states: int = 100_000):
        self._ranks = {(a, b): i for i, (a, b) in enumerate(tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges)}
        self._end, self._bound = end, states
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        self._char = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in set(shown))}
        self._next: dict[tuple[int, str], int] = {}  # trie of the vocabulary without word ends
        self._token: list[str | None] = [None]
        self._final: list[str | None] = [None]  # the token with a word end at this node
        for token in vocab:
            last = token.endswith(end)
            node = 0
            for c in token.removesuffix(end) if last else token:
                node = self._next.setdefault((node, c), len(self._token))
                if node == len(self._token):
                    self._token.append(None)
                    self._final.append(None)
            (self._final if last else self._token)[node] = token
        self._apart: dict[tuple[str, str], bool] = {}
        self.clear()

    def clear(self) -> None:
        self._states: dict[tuple, int] = {(): 0}
        self._open: list[tuple] = [((0, None, 0),)]
        self._moves: list[dict] = [{}]
        self._ends: list[dict] = [{}]

    def _symbols(self, token: str) -> list[str]:
        if token.endswith(self._end):
            chars = list(token.removesuffix(self._end))
            return [*chars[:-1], chars[-1] + self._end]
        return list(token)

    def merged(self, parts: list[str]) -> list[str]:
        """Plain byte-pair merging, lowest rank first."""
        parts = list(parts)
        while len(parts) > 1:
            rank, at = min((self._ranks.get(p, 1 << 60), i) for i, p in enumerate(zip(parts, parts[1:])))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fits(self, left: str | None, right: str) -> bool:
        """Merging leaves these two tokens apart where they meet."""
        if left is None:
            return True
        known = self._apart.get((left, right))
        if known is None:
            if len(self._apart) > 2_000_000:
                self._apart.clear()
            known = self._apart[left, right] = self.merged(self._symbols(left) + self._symbols(right)) == [left, right]
        return known

    def _step(self, state: int, char: str, last: bool) -> tuple[int, int]:
        """(next state, change of the count); -1 is the end of the word."""
        moved, best = [], None
        for node, before, count in self._open[state]:
            child = self._next.get((node, char))
            if child is None:
                continue
            moved.append((child, before, count))
            token = (self._final if last else self._token)[child]
            if best is None and token is not None and self._fits(before, token):
                best = (token, count + 1)
        if best is None:
            raise ValueError(f"no token ends at {char!r}")
        token, change = best
        if last:
            return -1, change
        moved = tuple((node, before, count - change) for node, before, count in moved) + ((0, token, 0),)
        known = self._states.get(moved)
        if known is None:
            known = self._states[moved] = len(self._open)
            self._open.append(moved)
            self._moves.append({})
            self._ends.append({})
        return known, change

    def _restart(self, state: int) -> int:
        """Forgets all states but the one a word stands in, so a word of any length keeps within the bound."""
        held = self._open[state]
        self.clear()
        if state == 0:
            return 0
        self._states[held] = len(self._open)
        self._open.append(held)
        self._moves.append({})
        self._ends.append({})
        return len(self._open) - 1

    def count(self, word: bytes) -> int:
        state = total = 0
        for b in word[:-1]:
            move = self._moves[state].get(b)
            if move is None:
                if len(self._open) > self._bound:
                    state = self._restart(state)
                move = self._moves[state][b] = self._step(state, self._char[b], False)
            state, change = move
            total += change
        b = word[-1]
        move = self._ends[state].get(b)
        if move is None:
            move = self._ends[state][b] = self._step(state, self._char[b], True)
        return total + move[1]


class Counter:
    """Token counts of texts as the tokenizer of a JSON file gives them, special strings in a text included."""

    def __init__(self, path: str, words: int = 400_000):
        spec = json.load(open(path))
        steps = spec["normalizer"]["normalizers"]
        assert [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and spec["model"]["end_of_word_suffix"], "compiled for lower-case vocabularies with word ends"
        self._special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]) or r"(?!)")
        self._transducer = Transducer(spec["model"]["vocab"], spec["model"]["merges"], spec["model"]["end_of_word_suffix"])
        self._known: dict[str, int] = {}
        self._bound, self._path = words, path

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # each character by itself, without the form at the end of words
                text = text.replace("Σ", "σ")
        return text.lower()

    def counts(self, texts: list[str]) -> np.ndarray:
        """One count for each text. A space parts the texts in the concatenation."""
        total = np.zeros(len(texts), np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if "<|" in text:
                pieces = self._special.split(text)
                total[i] += len(pieces) - 1
            else:
                pieces = [text]
            for piece in pieces:
                parts.append(self.normal(piece))
                owner.append(i)
        whole = " ".join(parts)
        points = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        if not len(points):
            return total
        kinds = classes(self._path)[points]
        begins = boundaries(kinds)
        ends = np.append(begins[1:], len(points))
        # a pre-token ends before the white space that may follow it
        solid = np.concatenate([[0], np.cumsum(kinds != SPACE)])
        ends = begins + (solid[ends] - solid[begins])
        known, found = self._known, []
        for s, e in zip(begins.tolist(), ends.tolist()):
            word = whole[s:e]
            n = known.get(word)
            if n is None:
                n = self._transducer.count(word.encode("utf-8", "replace"))
                if len(word) <= KEPT:
                    if len(known) >= self._bound:
                        known.clear()
                    known[word] = n
            found.append(n)
        sums = np.concatenate([[0], np.cumsum(np.array(found, np.int64))])
        edges = np.cumsum([len(p) + 1 for p in parts])
        per_part = np.diff(sums[np.concatenate([[0], np.searchsorted(begins, edges)])])
        np.add.at(total, owner, per_part)
        return total


@lru_cache(2)
def counter(path: str) -> Counter:
    """Compiled once in each worker, however many tasks it runs."""
    return Counter(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 2048) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text.

    A null text counts as empty (0 and 0); a null doc_id stays null; repeated rows each give a row; an empty table gives none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).counts
        for ids, texts in text_chunks(batches):
            n = count(texts)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], pa.int64()), pa.array(n), pa.array(n > limit)], names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).mapInArrow(run, COUNTS)
