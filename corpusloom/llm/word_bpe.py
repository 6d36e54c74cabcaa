"""Encoding whole texts with a tokenizers file whose pre-tokenizer drops white space, word by word.

No token of such a file crosses ASCII white space, nor does its normaliser (NFC, lower case) look across it.
So a text's ids are those of its words in turn, and each worker encodes a word only when it meets it first.

Words are remembered with their ASCII letters lowered, where that comes to the same: not before a character
beyond ASCII, as NFC comes first and a mark may compose with the small letter only; and not in the string of
a special token, which the library looks for in the text as it is.
"""

from __future__ import annotations

import functools
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class WordEncoder:
    """Ids as little-endian unsigned integers of the smallest width (2 or 4 bytes) that holds the vocabulary.

    Strings of special tokens in a text are ordinary text, or with `special` the ids of those tokens, as the
    library has it by default. A null text counts as empty. Two generations of about `words` words each are
    remembered (some 200 bytes a word).
    """

    def __init__(self, path: str, words: int = 600_000, special: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if not special:
            self.tokenizer.encode_special_tokens = True
        strings = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()] if special else []
        if any(len(s.split()) != 1 or s.strip() != s for s in strings):
            raise ValueError("a special token holds white space")
        self.strings = [s.lower() for s in strings]
        #: Words that are not lowered.
        self.apart = re.compile(b"|".join([rb"[A-Z][\x80-\xff]", *(b"(?i:%s)" % re.escape(s) for s in strings)])).search
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "<u4")
        self.words, self.young, self.old = words, {}, {}
        self.ends = {c: self._ids([chr(c)])[0] for c in b".,;:!?"}
        self.bar = self._ids(["|"])[0]

    def _ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _together(self, words: list[str]) -> list[bytes]:
        """The ids of words without the mark `|`: many in one text, parted by that mark. Less work than a text for each."""
        out: list[bytes] = []
        width, groups = self.dtype.itemsize, [words[i : i + 200] for i in range(0, len(words), 200)]
        for group, e in zip(groups, self.tokenizer.encode_batch_fast([" | ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype=self.dtype)
            cuts = np.flatnonzero(ids == np.frombuffer(self.bar, self.dtype)[0])
            if len(cuts) != len(group) - 1:
                out += self._ids(group)
                continue
            data, begins, ends = ids.tobytes(), [0, *((cuts + 1) * width).tolist()], [*(cuts * width).tolist(), len(ids) * width]
            out += [data[a:b] for a, b in zip(begins, ends, strict=True)]
        return out

    def _learn(self, missing: set[bytes]) -> None:
        old, young, plain, tailed = self.old, self.young, [], []
        for w in missing:
            if (ids := old.get(w)) is not None:
                young[w] = ids
            # A mark after a letter or digit is a pre-token of its own.
            elif len(w) > 1 and w[-1] in self.ends and (48 <= w[-2] <= 57 or 97 <= w[-2] <= 122):
                tailed.append(w)
            else:
                plain.append(w)
        stems = {w[:-1] for w in tailed}
        for w in stems:
            if (ids := old.get(w)) is not None:
                young[w] = ids
        plain.extend({w for w in stems if w not in young}.difference(plain))
        texts = [w.decode() for w in plain]
        many = [t for t in texts if "|" not in t]
        others = [t for t in texts if "|" in t]
        young.update(zip(map(str.encode, many), self._together(many), strict=True))
        young.update(zip(map(str.encode, others), self._ids(others), strict=True))
        for w in tailed:
            young[w] = young[w[:-1]] + self.ends[w[-1]]

    def _known(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word."""
        if missing := set(words).difference(self.young):
            self._learn(missing)
        return list(map(self.young.__getitem__, words))

    def _apart(self, text: str) -> bytes:
        """The ids of a text some of whose words are set apart, and not lowered as the file's normaliser does."""
        data = text.encode()
        return b"".join(self._known([a if a == b or not self.apart(b) else b for a, b in zip(data.lower().split(), data.split(), strict=True)]))

    def encode(self, texts: list[str | None], end: int | None = None) -> list[bytes]:
        """The ids of each text, followed by `end` if given."""
        if len(self.young) > self.words:
            self.old, self.young = self.young, {}
        tail = b"" if end is None else np.array([end], dtype=self.dtype).tobytes()
        whole = pc.fill_null(pa.array(texts, pa.string()), "")
        lowered = pc.ascii_lower(whole)
        apart = pc.match_substring_regex(whole, "[A-Z][^\\x00-\\x7f]")
        for s in self.strings:
            apart = pc.or_(apart, pc.match_substring(lowered, s.decode()))
        # Words of a batch are looked up once each. Next to white space at its ends a text has an empty word, which has no ids.
        split = pc.ascii_split_whitespace(pc.if_else(apart, "", lowered))
        words = split.flatten().dictionary_encode()
        ids = pa.array(self._known(words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(words.indices)
        begin, data = np.frombuffer(ids.buffers()[1], "<i8", len(ids) + 1, 8 * ids.offset), memoryview(ids.buffers()[2] or b"")
        cuts = begin[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist()
        return [(self._apart(t) if other else bytes(data[a:b])) + tail for t, other, a, b in zip(texts, apart.to_pylist(), cuts[:-1], cuts[1:], strict=True)]


@functools.cache
def encoder(path: str) -> WordEncoder:
    """One encoder for each file and worker process, with the library's defaults."""
    return WordEncoder(path, special=True)
