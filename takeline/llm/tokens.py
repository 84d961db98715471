"""Token ids of whole texts by a public tokenizer, word by word with a memo.

The tokenizer drops white space and never lets a token cross it, so a text's ids are its words' ids in order, and each
distinct word goes through the tokenizers library once per task.  Most words are letters with marks behind them; the
letters go to the library's BPE model directly, which spares its pre-tokenizer and the repeats with other marks.  Both
facts are probed when a tokenizer is loaded; without them whole texts, or whole words, are encoded.

Ids travel as little-endian unsigned 16-bit (vocabularies up to 65,536) or 32-bit integers.
"""

from __future__ import annotations

from array import array

import numpy as np

from takeline.llm.common import Memo

#: Longer words are encoded each time instead of being remembered.
LONG_WORD = 256
#: Marks that may follow a word's letters and are a token run of their own.
MARKS = b".,;:!?#$%&*<>|+=/()[]{}"
#: Byte to character as byte-level vocabularies write them: printable bytes stand for themselves, others follow from 256.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: chr(b) if b in _SHOWN else chr(256 + k) for b in range(256) for k in [sum(c not in _SHOWN for c in range(b))]}
PROBES = ("Hello,", "THE", "the!?", "of.%%%", "Of,###", "in&&&", "at|<>", "so*$;", "(it)", "to)]}", "été.", "Über;", "ñandú", "Straße:", "ÀÉÎÕÜ", "y", "ªº", "antidisestablishmentarianism...")


def default_tokenizer() -> str:
    """Path of the vocabulary file; it is installed beside the tokenizers on every machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordMemo(Memo):
    """A memo that computes words beyond ``LONG_WORD`` bytes each time."""

    def __missing__(self, key: bytes) -> bytes:
        return super().__missing__(key) if len(key) <= LONG_WORD else self.compute(key)


class TokenIds:
    """``packed(text)``: ids of a text's words followed by the end id, as bytes of ``dtype``."""

    def __init__(self, path: str | None = None, end_id: int | None = 1) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path or default_tokenizer())
        small = self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16
        self.dtype, self.code = np.dtype("<u2" if small else "<u4"), "H" if small else "I"
        self.end = b"" if end_id is None else array(self.code, [end_id]).tobytes()
        self.model = self.tokenizer.model
        self.runs = Memo(self._run)
        self.by_word = all(self._plain(f"{a} \n{b}\t") == self._plain(a) + self._plain(b) for a, b in zip(PROBES, PROBES[1:], strict=False))
        self.by_run = self.by_word and all(self._letters(p.encode()) == self._plain(p) for p in PROBES)
        self.memo = WordMemo(self._letters if self.by_run else lambda w: self._plain(w.decode()))

    def _plain(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, run: bytes) -> bytes:
        """Ids of lower-case letters, or of marks."""
        text = run.decode() if run.isascii() else "".join(map(BYTE_CHARS.__getitem__, run))
        return array(self.code, [t.id for t in self.model.tokenize(text)]).tobytes()

    def _letters(self, word: bytes) -> bytes:
        if len(word) > LONG_WORD:
            return self._plain(word.decode())
        letters = word.rstrip(MARKS)
        marks = word[len(letters) :]
        if letters.isalpha():  # of bytes: ASCII letters
            low = letters.lower()
        else:
            text = letters.decode()
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self._plain(word.decode())
            if not text.isalpha():  # Latin-1 letters are one run and lower to one letter each
                return self._plain(word.decode())
            low = text.lower().encode()
        return self.runs[low] + self.runs[marks] if marks else self.runs[low]

    def packed(self, text: bytes | None) -> bytes:
        """Null text has the end id alone."""
        if not self.by_word:
            return self._plain((text or b"").decode()) + self.end
        self.memo.trim()
        self.runs.trim()
        return b"".join(map(self.memo.__getitem__, (text or b"").split())) + self.end

    def ids(self, text: bytes | None) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.dtype)
