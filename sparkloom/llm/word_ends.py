"""Token ids of whole texts, with the words of byte-level vocabularies marked before the tokenizers library merges them.

Vocabularies of one form (``FORM``, as in ``word_bpe_49k.json``) normalise a text, cut it into words and merge the bytes
of each word, whose last symbol bears a suffix. The library spends over half its time on making each word an object of
its own. Here a word's last byte becomes a symbol of its own instead, and the vocabulary's tokens and merges are spelled in
these symbols. No merge has such a symbol at the end of its left side, so none goes past a word's end, and the library
finds the same ids when it merges a whole text in one go.

How characters are lower-cased and classed is asked of the library, one by one. Characters that this doesn't cover (marks
and letters that may be composed with others, those from U+3000 up, those that change their length in UTF-8), texts that
name a special token, malformed ones, and all texts of vocabularies of another form go through the vocabulary as it is.
"""

from __future__ import annotations

import json
import string
import unicodedata

import numpy as np

TOP = 0x3000
SPACE, LETTER, DIGIT, OTHER, UNKNOWN = range(5)
#: Where the library cuts ``a``, a character twice, and ``!``.
CUTS = {((0, 1), (3, 4)): SPACE, ((0, 3), (3, 4)): LETTER, ((0, 1), (1, 2), (2, 3), (3, 4)): DIGIT, ((0, 1), (1, 4)): OTHER}
FORM = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "truncation": None,
    "padding": None,
}
MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def symbols() -> np.ndarray:
    """A code point for each byte, and for each byte that ends a word.

    Short ones go to what is frequent: upper-case letters, which texts have no more, to letters at the end of a word, and
    control codes to signs there.
    """
    last = {b: b - 32 for b in range(97, 123)} | {b: i for i, b in enumerate(string.punctuation.encode())}
    own = [b if b < 128 and b not in last.values() else 0x100 + b for b in range(256)]
    return np.array(own + [last.get(b, 0x200 + b) for b in range(256)], "<u2")


def marked_model(spec: dict):
    """The tokenizer of marked texts, or None for a vocabulary of another form."""
    from tokenizers import Tokenizer
    from tokenizers.models import BPE

    model, added = spec["model"], spec["added_tokens"]
    suffix = model.get("end_of_word_suffix")
    if not suffix or any(spec[k] != v for k, v in FORM.items()) or any(model[k] != v for k, v in MODEL.items()):
        return None
    if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    byte, names = byte_letters(), symbols()
    special = {t["content"] for t in added}

    def spell(token: str) -> str:
        core, ends = (token[: -len(suffix)], True) if token.endswith(suffix) else (token, False)
        codes = [byte[c] for c in core]
        if ends:
            codes[-1] += 256
        return "".join(chr(names[c]) for c in codes)

    try:
        vocab = {spell(t): i for t, i in model["vocab"].items() if t not in special}
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        if any(left.endswith(suffix) for left, _ in pairs):
            return None
        merges = [(spell(left), spell(right)) for left, right in pairs]
    except (KeyError, IndexError):
        return None
    if len(vocab) != len(set(model["vocab"]) - special) or not all(chr(n) in vocab for n in names):
        return None
    return Tokenizer(BPE(vocab, merges, cache_capacity=0))


def character_tables(tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """For each character below ``TOP`` what it becomes, and its kind, both from the library."""
    becomes, kinds = np.arange(TOP), np.full(TOP, UNKNOWN, np.uint8)
    for i in range(TOP):
        c = chr(i)
        # Marks and conjoining Jamo are all that canonical composition joins to what is before them.
        if unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Cn" or 0x1100 <= i < 0x1200:
            continue
        low = tokenizer.normalizer.normalize_str(c)
        if len(low) != 1:
            continue
        kind = CUTS.get(tuple(at for _, at in tokenizer.pre_tokenizer.pre_tokenize_str(f"a{low}{low}!")), UNKNOWN)
        if kind == SPACE or len(low.encode()) == len(c.encode()):
            becomes[i], kinds[i] = i if kind == SPACE else ord(low), kind
    return becomes, kinds


class WholeTexts:
    """Ids of texts, given in UTF-8, under the vocabulary of a file of the tokenizers library."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.marked = marked_model(spec)
        if self.marked is not None:
            self.special = [t["content"].encode() for t in spec["added_tokens"]]
            self.becomes, self.kinds = character_tables(self.plain)
            self.low = np.arange(256, dtype=np.uint8)
            self.low[:128] = self.becomes[:128]
            self.kind = np.full(256, UNKNOWN, np.uint8)
            self.kind[:128] = self.kinds[:128]
            self.symbols = symbols()

    def __call__(self, texts: list[bytes]) -> list[list[int]]:
        if self.marked is None:
            return self._as_is(texts)
        marked = self.mark(texts)
        rest = [i for i, m in enumerate(marked) if m is None]
        out = [e.ids for e in self.marked.encode_batch_fast([m or "" for m in marked], add_special_tokens=False)]
        for i, ids in zip(rest, self._as_is([texts[i] for i in rest]), strict=True):
            out[i] = ids
        return out

    def _as_is(self, texts: list[bytes]) -> list[list[int]]:
        return [e.ids for e in self.plain.encode_batch_fast([t.decode("utf-8") for t in texts], add_special_tokens=False)]

    def mark(self, texts: list[bytes]) -> list[str | None]:
        """Texts in symbols, words' last ones marked and spaces left out; None where the vocabulary has to be used as it is."""
        joined = b"\n".join(texts) + b"\n\n\n"
        given = np.frombuffer(joined, np.uint8)
        buf = self.low[given]
        kind = self.kind[buf]
        wide = np.flatnonzero(given >= 0xC2)
        if len(wide):
            self._wide(given, buf, kind, wide)
        end = np.zeros(len(buf), bool)
        np.not_equal(kind[:-1], kind[1:], out=end[:-1])
        end |= kind == DIGIT
        if len(wide):
            end[:-1] &= (buf[1:] & 0xC0) != 0x80
        self._contractions(buf, kind, end)
        starts = np.cumsum([0] + [len(t) + 1 for t in texts])
        keep = kind != SPACE
        out = self.symbols[buf[keep] + (end[keep].astype(np.uint16) << 8)].tobytes().decode("utf-16-le")
        at = np.concatenate([[0], np.cumsum(np.add.reduceat(keep, starts[:-1], dtype=np.int64))]).tolist()
        marked: list[str | None] = [out[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
        for i in np.unique(np.searchsorted(starts, np.flatnonzero(kind == UNKNOWN), "right") - 1).tolist():
            marked[i] = None
        if any(s in joined for s in self.special):
            marked = [None if any(s in t for s in self.special) else m for t, m in zip(texts, marked, strict=True)]
        return marked

    def _wide(self, given: np.ndarray, buf: np.ndarray, kind: np.ndarray, lead: np.ndarray) -> None:
        """Lower-case and class the characters of two and three bytes; bytes of all others keep ``UNKNOWN``."""
        first = given[lead].astype(np.int64)
        second, third = given[lead + 1].astype(np.int64), given[lead + 2].astype(np.int64)
        for n, mine in ((2, first < 0xE0), (3, (first >= 0xE0) & (first < 0xF0))):
            b = second[mine], third[mine]
            code = (first[mine] & 0x1F) << 6 | b[0] & 0x3F if n == 2 else (first[mine] & 0x0F) << 12 | (b[0] & 0x3F) << 6 | b[1] & 0x3F
            sound = (b[0] & 0xC0) == 0x80
            if n == 3:
                sound &= ((b[1] & 0xC0) == 0x80) & (code >= 0x800)
            sound &= code < TOP
            at, code = lead[mine][sound], code[sound]
            to = self.becomes[code]
            for k in range(n):
                kind[at + k] = self.kinds[code]
                buf[at + k] = (to >> 6 * (n - 1 - k)) & 0x3F | 0x80 if k else given[at] & 0xE0 if n == 2 else 0xE0
            buf[at] |= (to >> 6 * (n - 1)).astype(np.uint8)

    @staticmethod
    def _contractions(buf: np.ndarray, kind: np.ndarray, end: np.ndarray) -> None:
        """``'s 't 'm 'd 're 've 'll`` are words where a run of other signs begins with their apostrophe."""
        q = np.flatnonzero(buf == ord("'"))
        q = q[(kind[q - 1] != OTHER) | (q == 0)]
        a, b = buf[q + 1], buf[np.minimum(q + 2, len(buf) - 1)]
        one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
        two = ((b == ord("e")) & ((a == ord("r")) | (a == ord("v")))) | ((a == ord("l")) & (b == ord("l")))
        end[q[one | two]] = False
        end[q[one] + 1] = True
        end[q[two] + 2] = True
