"""Exact encoding with a public tokenizer, with the ids of repeated words kept per worker.

A vocabulary that folds white space and case has its usual texts lower-cased and cut as a whole, and each part looked
up. Otherwise pre-tokenisation cuts at every single space between two other characters, so the ids of a text are
the ids of its words one after the other. Each word is encoded once and looked up afterwards: plain
ones (letters and final punctuation) by the library's model directly, all others by its normaliser,
pre-tokeniser and model. A single line end between two words is a word's end too. Tables hold twice
``WORDS_HELD`` and ``PARTS_HELD`` entries: a full one becomes the old one, from which what is still
asked for is taken over, so frequent words stay. That bounds a worker's memory (to about 150 MB) and
changes no result.
"""

from __future__ import annotations

import functools
import json
import re
import string
import unicodedata
from array import array

WORDS_HELD = 150_000
PARTS_HELD = 200_000
#: Fixed value: the cut of vocabularies whose normaliser folds white space and case.
FOLDED = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_INNER_SPACE = re.compile(r"(?<=\S) (?=\S)")
_RARE_SPACE = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
#: Up to here a letter is its own normal form, and Python's and the library's letters are the same.
_PLAIN = "ɏ"


def _byte_alphabet() -> dict[int, str]:
    """A character for every byte: itself if it is printable in Latin-1, else one from 256 on, in order."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) if b in shown else chr(256 + hidden.index(b)) for b in range(256)}


_ALPHABET = _byte_alphabet()


#: Characters that both libraries are sure to class alike.
_SURE = re.compile("[^\t\n -~\u00a1-\u024f]")


def _folded() -> re.Pattern:
    """``FOLDED`` for lower-case texts of sure characters; some of those have lower-case letters beyond them."""
    sure = sorted({c for k in range(0x250) for c in (chr(k), *chr(k).lower())})

    def chars(kind: str) -> str:
        return "".join(c for c in sure if unicodedata.category(c).startswith(kind))

    return re.compile(FOLDED.replace("\\p{L}", chars("L")).replace("\\p{N}", chars("N")))


class _Table(dict):
    """Values that are made when they are first asked for; of ``most`` entries and as many older ones."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def _folds(told: dict) -> bool:
    """Whether the file's tokenizer folds white space and case, and cuts by ``FOLDED``."""
    steps = (told.get("normalizer") or {}).get("normalizers", [])
    cuts = (told.get("pre_tokenizer") or {}).get("pretokenizers", [])
    plain = [n["type"] for n in steps] == ["NFC", "Replace", "Lowercase"] and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
    return (plain and [c["type"] for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": FOLDED}
            and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"] and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"])


class WordEncoder:
    """``encode(text)``: the ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer, models

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        # The library's own cache of words is small and costs more than it saves here.
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
        kept = {k: v for k, v in told["model"].items() if k in ("unk_token", "end_of_word_suffix", "continuing_subword_prefix") and v}
        self.tokenize = models.BPE(told["model"]["vocab"], merges, cache_capacity=0, **kept).tokenize
        self.split_up = self.whole.pre_tokenizer.pre_tokenize_str
        self.special = [t["content"] for t in told["added_tokens"]]
        #: A normaliser that folds white space and case drops spaces: words then need no leading one.
        self.normalize = self.whole.normalizer.normalize_str if self.whole.normalizer else None
        self.space = _ALPHABET[32]
        self.line_end = b"" if self.normalize else array("I", [t.id for t in self.tokenize(_ALPHABET[10])]).tobytes()
        #: Ids of pre-tokens (in bytes' characters), of words after a space, and of a text's first words.
        self.parts = _Table(lambda part: array("I", [t.id for t in self.tokenize(part)]).tobytes(), PARTS_HELD)
        self.words = _Table(functools.partial(self._word, "" if self.normalize else " "), WORDS_HELD)
        self.firsts = _Table(functools.partial(self._word, ""), WORDS_HELD // 4)
        #: Ids of pre-tokens as they stand in a folded text, and how it is cut into them, if it is the known way.
        self.folded = _Table(lambda part: array("I", [t.id for t in self.tokenize(self._mapped(part))]).tobytes(), PARTS_HELD)
        self.cut = _folded().findall if _folds(told) else None

    def _mapped(self, text: str) -> str:
        return text.encode().decode("latin-1").translate(_ALPHABET)

    def _word(self, lead: str, word: str) -> bytes:
        letters = word.rstrip(string.punctuation)
        if letters.isascii() and letters.isalpha():
            # Most words: their letters stand for themselves in the byte alphabet.
            ids = self.parts[letters.lower() if self.normalize else self.space + letters if lead else letters]
            return ids if len(letters) == len(word) else ids + self.parts[word[len(letters):]]
        out = []
        for k, line in enumerate(word.split("\n")):
            letters = line.rstrip(string.punctuation)
            if not letters.isalpha() or max(letters) > _PLAIN:
                break
            if k and not self.normalize:
                out.append(self.parts[_ALPHABET[10]])
            out.append(self.parts[self._mapped(letters.lower() if self.normalize else letters if k else lead + letters)])
            if len(letters) < len(line):
                out.append(self.parts[line[len(letters):]])
        else:
            return b"".join(out)
        word = lead + word
        if any(s in word for s in self.special):
            return array("I", self.whole.encode(word, add_special_tokens=False).ids).tobytes()
        return b"".join(self.parts[p] for p, _ in self.split_up(self.normalize(word) if self.normalize else word))

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if self.cut and not _SURE.search(text) and not any(s in text for s in self.special):
            # One table of parts for all cases and punctuations of a word.
            return b"".join(map(self.folded.__getitem__, self.cut(text.lower())))
        if self.normalize:
            return b"".join(map(self.words.__getitem__, text.replace("\n", " ").split(" ")))
        uneven = ("  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[:1] == " " or text[-1:] == " "
                  or any(c in text for c in _RARE_SPACE))
        word, first = self.words.__getitem__, self.firsts.__getitem__
        if uneven:
            head, *others = _INNER_SPACE.split(text)
            return first(head) + b"".join(map(word, others))
        out = []
        for line in text.split("\n"):
            head, *others = line.split(" ")
            out.append(first(head))
            out += map(word, others)
            out.append(self.line_end)
        return b"".join(out[:-1])


#: Fixed value: how byte-level vocabularies of this kind cut a text before merging.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteEncoder:
    """The same for a byte-level vocabulary whose ids are in the order of its merges, through the faster of two public libraries.

    Texts with characters that the libraries might class differently, or with a special token, take the other way.
    """

    def __init__(self, path: str, ranks: dict[bytes, int]):
        import tiktoken

        self.other = WordEncoder(path)
        self.ordinary = tiktoken.Encoding("bytes", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, text: str | None) -> bytes:
        text = text or ""
        if _SURE.search(text) or any(s in text for s in self.other.special):
            return self.other.encode(text)
        return array("I", self.ordinary(text)).tobytes()


def _byte_ranks(path: str) -> dict[bytes, int] | None:
    """Ids by the bytes of their tokens, if the file's tokenizer is a plain byte-level one; else None."""
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, pre = told["model"], told.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if not plain or told.get("normalizer") or model.get("type") not in (None, "BPE") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
        return None
    special = {t["content"] for t in told["added_tokens"]}
    back = {c: b for b, c in _ALPHABET.items()}
    ranks = {bytes(back[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    merged = [ranks[bytes(back[c] for part in (m if isinstance(m, list) else m.split(" ")) for c in part)] for m in model["merges"]]
    ordered = all(a < b for a, b in zip(merged, merged[1:])) and len(merged) + 256 == len(ranks)
    return ranks if ordered and all(bytes([b]) in ranks for b in range(256)) else None


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder | ByteEncoder:
    """The worker's encoder for a tokenizer file."""
    ranks = _byte_ranks(path)
    return ByteEncoder(path, ranks) if ranks else WordEncoder(path)
