"""Token ids with a public vocabulary file, fast on text whose words recur."""

from __future__ import annotations

import re

import numpy as np

#: Words whose ids a worker keeps of late at most; as many again are kept of before.
CACHE_WORDS = 350_000
#: Unseen words that are encoded together.
_JOINED = 200

_LETTERS = "a-zß-öø-ÿœ"
#: Characters whose class and lower case are beyond doubt: ASCII, the letters of Western Europe, common punctuation.
_PLAIN = re.compile("[\t\n\r\x20-\x7eÀ-ÖØ-öø-ÿŒœ¡«»¿–—‘-„…€]*")
#: How the vocabulary parts lower-case text of such characters.
_WORDS = re.compile(f"[{_LETTERS}]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\\s0-9{_LETTERS}]+")


class WordCachedTokenizer:
    """Ids of texts by the 49k-word vocabulary, which lower-cases text and encodes each word of it for itself.

    Each word is encoded once and then looked up. Plain text is cut into words here, other text at spaces and line feeds,
    which the vocabulary never joins. Unseen words of plain text are encoded together and told apart by the mark that the
    vocabulary puts at the end of each word.
    """

    _shared: dict[str, WordCachedTokenizer] = {}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.id_bytes = [i.to_bytes(4, "little") for i in range(size)]
        self.ends = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.known: dict[str, bytes] = {"": b""}
        self.before: dict[str, bytes] = {}

    @classmethod
    def shared(cls, path: str | None = None) -> WordCachedTokenizer:
        """One for each Python worker and file; the default file is the public 49k-word vocabulary."""
        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; none for a null."""
        if len(self.known) > CACHE_WORDS:
            self.before, self.known = self.known, {"": b""}
        known, before = self.known, self.before
        plain = [bool(_PLAIN.fullmatch(x or "")) and "<|" not in (x or "") for x in texts]
        parts = [_WORDS.findall((x or "").lower()) if ok else (x or "").replace("\n", " ").split(" ") for x, ok in zip(texts, plain, strict=True)]
        for ok in (True, False):
            new = set().union(*[words for words, is_plain in zip(parts, plain, strict=True) if is_plain is ok]).difference(known)
            old = [word for word in new if word in before]
            for word in old:
                known[word] = before[word]
            new.difference_update(old)
            if new:
                self._learn(sorted(new), ok)
        return [b"".join(map(known.__getitem__, words)) for words in parts]

    def _learn(self, words: list[str], plain: bool) -> None:
        """plain: each word is one for the vocabulary too, so a run of them splits at the ids that end a word."""
        alone = words
        if plain:
            # printable ASCII stands for itself in the byte alphabet, so the model may be asked directly
            ask, id_bytes, known = self.tokenizer.model.tokenize, self.id_bytes, self.known
            for word in words:
                if word.isascii():
                    known[word] = b"".join([id_bytes[t.id] for t in ask(word)])
            words = [word for word in words if not word.isascii()]
            runs = [words[at : at + _JOINED] for at in range(0, len(words), _JOINED)]
            alone = []
            for run, found in zip(runs, self.tokenizer.encode_batch_fast([" ".join(x) for x in runs], add_special_tokens=False), strict=True):
                ids = np.array(found.ids, dtype="<u4")
                edges = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(edges) != len(run):
                    alone += run
                    continue
                data, start = ids.tobytes(), 0
                for word, end in zip(run, edges, strict=True):
                    self.known[word] = data[4 * start : 4 * end]
                    start = end
        for word in alone:
            self.known[word] = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()
