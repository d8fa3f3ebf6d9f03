"""Token ids of whole texts by the tokenizers library, one word at a time with a bounded memory of words seen.

A byte-level BPE first cuts a text by a pattern in which a word takes the single space before it. A place between a visible
character and a space that another visible character follows is therefore always a cut, and the parts can be encoded on
their own. Words repeat, so each worker keeps the ids of recent ones.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

BYTE_BPE = "byte_bpe_50k.json"
#: Words in each of a worker's two generations of memory, and the longest word worth it: at most some 160 MB.
REMEMBERED = 400_000
LONGEST = 40
#: Words of one text encoded in one call.
AT_ONCE = 50_000

_CUT = re.compile(r"(?<=\S)(?= \S)")
_DOUBLE = re.compile(r"\s\s")


def tokenizer_path(name: str = BYTE_BPE) -> str:
    return public_tokenizers.path(name)


#: Characters of the texts encoded together.
BATCH_CHARS = 2_000_000

#: A word, or two that a line's end parts, each one run of letters for the tokenizer's pattern with or without marks behind it.
_RUN, _MARKS = "([A-Za-zÀ-ÖØ-öø-ɏ]+)", "([!-&(-/:-@[-`{-~]*"
_PLAIN = re.compile(f"{_RUN}{_MARKS})|{_RUN}{_MARKS}\n){_RUN}{_MARKS})").fullmatch
#: Strings of marks a worker remembers.
MARKS = 10_000


def _byte_letters() -> dict[int, str]:
    """The character by which a byte-level vocabulary writes each byte: itself if printable, else the next above 255."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class IdEncoder:
    """Texts to ids, as little-endian unsigned 32-bit numbers; no special tokens are added."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.marks: dict[str, list[int]] = {"": []}

    def _encoded(self, parts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _mark(self, text: str) -> list[int]:
        """The ids of marks behind a run of letters, which the pattern keeps apart from it."""
        ids = self.marks.get(text)
        if ids is None:
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
            if len(self.marks) < MARKS and len(text) <= LONGEST:
                self.marks[text] = ids
        return ids

    def _run(self, letters: str) -> list[int]:
        """The ids of a run of letters, with or without a space before it, by the model alone."""
        written = letters.replace(" ", self.letters[32]) if letters.isascii() else letters.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(written)]

    def _learn(self, words: set[str]) -> None:
        """Make the ids of words, each with a space before it, known. Runs of letters go to the model without its pattern."""
        young, old, tokenize, space = self.young, self.old, self.model.tokenize, self.letters[32]
        odd, runs, n = [], [], []
        ids: list[int] = []
        for w in words:
            if (known := old.get(w)) is not None:
                young[w] = known
                continue
            if w.isascii() and w.isalpha():
                ids += [t.id for t in tokenize(space + w)]
            elif plain := _PLAIN(w):
                run, marks, line, end, run_2, marks_2 = plain.groups()
                if run:
                    ids += self._run(" " + run) + self._mark(marks)
                else:
                    ids += self._run(" " + line) + self._mark(end) + self._run(run_2) + self._mark(marks_2)
            else:
                odd.append(w)
                continue
            runs.append(w)
            n.append(len(ids))
        plain = array("I", ids).tobytes()
        at = 0
        for w, end in zip(runs, n):
            young[w] = plain[4 * at : 4 * end]
            at = end
        young.update(zip(odd, self._encoded([" " + w for w in odd])))

    def _forget(self, words: set[str]) -> None:
        for w in words:
            if len(w) > LONGEST:
                self.young.pop(w, None)
        if len(self.young) > REMEMBERED:
            self.old, self.young = self.young, {}

    def encode(self, text: str | None) -> bytes:
        """One text, whatever its length and white space."""
        if not text:
            return b""
        if _DOUBLE.search(text):
            head, *rest = _CUT.split(text)
            rest = [r[1:] for r in rest]
        else:  # every space stands between visible characters, or at an end
            head, *rest = text.split(" ")
        out = self._encoded([head]) if head else []
        for at in range(0, len(rest), AT_ONCE):  # of a very long text never all words at once
            run = rest[at : at + AT_ONCE]
            unseen = set(run).difference(self.young)
            self._learn(unseen)
            out.extend(map(self.young.__getitem__, run))
            self._forget(unseen)
        return b"".join(out)

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The ids of each text in turn; common texts some million characters at a time."""
        wait: list[str | None] = []
        size = 0
        for text in texts:
            if text and (len(text) > BATCH_CHARS or _DOUBLE.search(text)):
                yield from self._together(wait)
                yield self.encode(text)
                wait, size = [], 0
                continue
            wait.append(text)
            size += len(text or "")
            if size > BATCH_CHARS:
                yield from self._together(wait)
                wait, size = [], 0
        yield from self._together(wait)

    def _together(self, texts: list[str | None]) -> list[bytes]:
        """Texts without double white space: their words are numbered at once and each distinct one is looked up once."""
        if not texts:
            return []
        split = pc.split_pattern(pa.array([t or "" for t in texts], pa.large_string()), " ")
        coded = split.values.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        unseen = set(distinct).difference(self.young)
        self._learn(unseen)
        first = split.offsets.to_numpy()[:-1]
        heads = self._encoded([t.partition(" ")[0] if t else "" for t in texts])
        ids = [*map(self.young.__getitem__, distinct), *heads]
        self._forget(unseen)
        word = coded.indices.to_numpy().astype(np.int64)
        word[first] = len(distinct) + np.arange(len(texts))  # a text's first word has no space before it
        flat = pa.array(ids, pa.large_binary()).take(pa.array(word))
        plain = memoryview(flat.buffers()[2] or b"")
        bounds = np.frombuffer(flat.buffers()[1], np.int64)[split.offsets.to_numpy()].tolist()
        return [bytes(plain[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]


@cache
def encoder(path: str) -> IdEncoder:
    """The encoder of this worker process; the tasks it runs one after the other share it."""
    return IdEncoder(path)
