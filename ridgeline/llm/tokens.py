"""Token ids of text columns by a public tokenizer file, as its library gives them.

Texts are cut where white space follows other characters. The pre-tokenizers of SPLITTABLE join nothing across
such a place, so a text's ids are those of its parts in a row. Parts repeat: those of a batch are numbered by
Arrow, the library encodes each different one once (many in a call, with an added token between them, around which
it encodes each part on its own), and the ids of the texts are gathered from theirs. A bounded cache keeps parts
from batch to batch. Texts that hold an added token's beginning or white space beyond ASCII, and all texts of other
tokenizers, are encoded whole, one library call a text.
"""

from __future__ import annotations

import os

import numpy as np
import pyarrow as pa

from ridgeline.llm.hashing import BLANKS, text_bytes

_LETTERS, _WORDLIKE = np.zeros(256, bool), np.zeros(256, bool)
_LETTERS[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_WORDLIKE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

SPLITTABLE = ("byte_bpe_50k.json", "word_bpe_49k.json")
CACHED = 100_000
#: Parts above this many characters are not kept.
LONGEST_KEPT = 64
BAR = "|"
#: Parts that one library call encodes.
TOGETHER = 256

#: First bytes of white space beyond ASCII in UTF-8, and the bytes that follow them.
_WIDE_BLANKS = {0xC2: [(0x85,), (0xA0,)], 0xE1: [(0x9A, 0x80)], 0xE3: [(0x80, 0x80)],
                0xE2: [(0x80, b) for b in (*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF)] + [(0x81, 0x9F)]}


class Encoder:
    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        added = self.tokenizer.get_added_tokens_decoder().items()
        plain = [(number, token.content) for number, token in added if not (token.lstrip or token.rstrip or token.single_word)]
        self.splits = os.path.basename(file) in SPLITTABLE and bool(plain)
        self.between, self.mark = plain[0] if plain else (0, "")
        # Beside letters and blanks this character is a piece of its own, whose id no word has.
        bars = self._whole(BAR)
        self.bar = int(bars[0])
        self.splits = self.splits and len(bars) == 1
        self.openings = sorted({token.content[:2] for _, token in added})
        self.kept: dict[str, bytes] = {}

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def _encoded(self, parts: list[str]) -> dict[str, bytes]:
        """The ids of each part, as bytes."""
        found, words, others = {}, [], []
        for part in parts:
            # A last letter that is not ASCII may become two characters.
            if part[-1].isascii() and (part.isalpha() or (part[0] == " " and part[1:].isalpha())):
                words.append(part)
            elif any(o in part for o in self.openings):
                found[part] = self._whole(part).tobytes()
            else:
                others.append(part)
        self._joined(words, BAR, self.bar, found)
        self._joined(others, self.mark, self.between, found)
        return found

    def _joined(self, parts: list[str], mark: str, between: int, found: dict[str, bytes]) -> None:
        """Puts the ids of parts into found: the library encodes many of them in a row, and their ids lie between those of mark."""
        for at in range(0, len(parts), TOGETHER * 64):
            groups = [parts[i : i + TOGETHER] for i in range(at, min(len(parts), at + TOGETHER * 64), TOGETHER)]
            for group, call in zip(groups, self.tokenizer.encode_batch_fast([mark.join(g) for g in groups], add_special_tokens=False)):
                ids = np.array(call.ids, np.uint32)
                raw, start = ids.tobytes(), 0
                for part, end in zip(group, [*(4 * np.flatnonzero(ids == between)).tolist(), len(raw)], strict=True):
                    found[part] = raw[start:end]
                    start = end + 4

    def _odd(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which of the texts have to be encoded whole."""
        odd = np.zeros(len(at) - 1, bool)

        def mark(places: np.ndarray) -> None:
            odd[np.searchsorted(at, places, side="right") - 1] = True

        endings = [(o[0], [tuple(o[1:])]) for o in (opening.encode() for opening in self.openings)]
        for first, rests in [*endings, *_WIDE_BLANKS.items()]:
            leads = np.flatnonzero(raw == first)
            for rest in rests:
                fits = leads[leads + len(rest) < len(raw)]
                for k, byte in enumerate(rest):
                    fits = fits[raw[fits + k + 1] == byte]
                mark(fits)
        return odd

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids (unsigned 32-bit) of all texts of a column in a row, and where each text's start and the last one's end."""
        raw, at = text_bytes(column)
        texts = len(at) - 1
        if not self.splits or len(raw) == 0:
            each = [self._whole(t or "") for t in column.to_pylist()]
            return np.concatenate([*each, np.zeros(0, np.uint32)]), np.concatenate([[0], np.cumsum([len(e) for e in each], dtype=np.int64)]).astype(np.int64)
        odd = self._odd(raw, at)
        blank, letter = BLANKS[raw], _LETTERS[raw]
        cut = np.zeros(len(raw), bool)
        cut[1:] = (letter[:-1] & ~_WORDLIKE[raw[1:]]) | (blank[1:] & ~blank[:-1])
        if odd.any():
            cut &= np.repeat(~odd, np.diff(at))
        cut[at[:-1][at[:-1] < at[1:]]] = True
        cuts = np.flatnonzero(cut)
        offsets = np.append(cuts, len(raw)).astype(np.int64)
        # Arrow numbers the parts: equal ones have one number.
        arrays = pa.Array.from_buffers(pa.large_string(), len(cuts), [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).dictionary_encode()
        distinct, number = arrays.dictionary.to_numpy(zero_copy_only=False).tolist(), arrays.indices.to_numpy()
        kept = self.kept
        fresh = self._encoded([part for part in distinct if part not in kept])
        ids = [fresh[part] if part in fresh else kept[part] for part in distinct]
        kept.update(fresh)
        if len(kept) > CACHED:
            self.kept = {part: found for part, found in zip(distinct, ids) if len(part) <= LONGEST_KEPT}
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, first = np.frombuffer(b"".join(ids), np.uint32), np.cumsum(size) - size
        length = size[number]
        upto = np.concatenate([[0], np.cumsum(length)])
        gathered = flat[np.repeat(first[number] - upto[:-1], length) + np.arange(upto[-1])]
        return gathered, upto[np.searchsorted(cuts, at)]


def with_end(ids: np.ndarray, at: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """ids and places of texts with the id end after each text."""
    return np.insert(ids, at[1:], np.uint32(end)), at + np.arange(len(at))


_ENCODERS: dict[str, Encoder] = {}


def path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(name: str) -> Encoder:
    """One encoder per Python worker; name: a file of the public tokenizers, or the path of one."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name if "/" in name else path(name))
    return _ENCODERS[name]
