"""Token ids of texts by a public tokenizer, each distinct piece encoded once.

Both kinds of tokenizer handled here never let a token reach from a character that is no white space to
a space, so a text can be cut there and its ids are those of its pieces. Pieces are encoded by the library itself;
letters followed by ASCII punctuation are cut once more, and many words go into one call.
Tokenizers of any other make get whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import filterfalse

import numpy as np

#: Punctuation that both patterns cut off after letters. No apostrophe (contractions)
#: and no "<" (special tokens).
TAIL = "!\"#$%&()*+,-./:;=>?@[\\]^_`{|}~"
_CUT = re.compile(r"(?<=\S)(?= )")
#: A space after white space of any kind: a token may hold both.
_RUN = re.compile(r" (?<=\s )")
_PER_CALL = 200


def kind_of(config: dict) -> str:
    """``words``, ``bytes`` or ``other``: how texts may be cut."""
    pre, norm = config.get("pre_tokenizer") or {}, config.get("normalizer")
    if any(re.search(r"\s", t["content"]) or t["lstrip"] or t["rstrip"] or t["normalized"] for t in config.get("added_tokens", [])):
        return "other"
    if config.get("post_processor") or config.get("truncation") or config.get("padding"):
        return "other"
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and norm is None:
        return "bytes"
    steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
    cuts = [x.get("type") for x in pre.get("pretokenizers", [])]
    ends = config["model"].get("end_of_word_suffix")
    if steps == ["NFC", "Replace", "Lowercase"] and cuts == ["Split", "ByteLevel"] and ends:
        first = pre["pretokenizers"][0]
        if first["behavior"] == "Removed" and first["invert"] and norm["normalizers"][1]["content"] == " ":
            return "words"
    return "other"


class Pieces:
    """Ids of whole texts, as ``encode(text, add_special_tokens=False)`` gives them.

    The memo holds ids as bytes (32 bits each): they are joined at the speed of a copy.
    """

    def __init__(self, content: bytes, most: int = 1_000_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        config = json.loads(content)
        self.kind, self.most = kind_of(config), most
        self.tokenizer = Tokenizer.from_str(content.decode())
        self.inner: dict[str, bytes] = {}
        self.first: dict[str, bytes] = {}
        vocab = self.tokenizer.get_vocab()
        self.mark = np.zeros(max(vocab.values()) + 1, bool)
        if self.kind == "words":
            end = config["model"]["end_of_word_suffix"]
            self.mark[[i for t, i in vocab.items() if t.endswith(end)]] = True
        elif self.kind == "bytes":
            self.mark[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
            self.newline = self._direct(["\n"])[0]

    def _direct(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, np.int32).tobytes() for e in found]

    def _words(self, words: list[str], spaced: bool) -> list[bytes]:
        """Words of letters only. ``spaced``: each with the space before it."""
        if self.kind == "bytes" and not spaced and len(self.newline) != 4:
            return self._direct(words)
        lists = [words[i : i + _PER_CALL] for i in range(0, len(words), _PER_CALL)]
        if self.kind == "words":
            calls = [" ".join(x) for x in lists]
        elif spaced:
            calls = [" " + " ".join(x) for x in lists]
        else:
            calls = ["\n".join(x) for x in lists]
        out = []
        for own, e in zip(lists, self.tokenizer.encode_batch_fast(calls, add_special_tokens=False)):
            got = np.array(e.ids, np.int32)
            if self.kind == "words":
                ends = np.flatnonzero(self.mark[got]) + 1
                starts = np.append(0, ends[:-1])
                whole = len(ends) == len(own) and ends[-1] == len(got)
            elif spaced:
                starts = np.flatnonzero(self.mark[got])
                ends = np.append(starts[1:], len(got))
                whole = len(starts) == len(own) and starts[0] == 0
            else:
                cuts = np.flatnonzero(got == np.frombuffer(self.newline, np.int32))
                starts, ends = np.append(0, cuts + 1), np.append(cuts, len(got))
                whole = len(starts) == len(own)
            if whole:
                raw = got.tobytes()
                out += [raw[a:b] for a, b in zip((starts * 4).tolist(), (ends * 4).tolist())]
            else:
                out += self._direct([" " + x if spaced else x for x in own])
        return out

    def _resolve(self, pieces, spaced: bool) -> None:
        """Fill the memo for pieces not met before."""
        memo = self.inner if spaced else self.first
        simple, heads, rest, lines = [], set(), [], []
        for p in pieces:
            head = p.rstrip(TAIL)
            # the small form of one letter depends on what follows, that of another is no letter
            if head and head.isalpha() and head.lower().isalpha() and "Σ" not in head:
                tail = p[len(head) :]
                if head not in memo:
                    heads.add(head)
                if tail:
                    simple.append((p, head, tail))
            elif self.kind == "bytes" and "\n" in p and (q := p.split("\n")) == p.split():
                lines.append((p, q))
            else:
                rest.append(p)
        new = list(heads)
        memo.update(zip(new, self._words(new, spaced)))
        if tails := _missing({t for _, _, t in simple}, self.first):
            self.first.update(zip(tails, self._direct(tails)))
        for p, head, tail in simple:
            memo[p] = memo[head] + self.first[tail]
        if lines:
            if inner := _missing({q[0] for _, q in lines}, memo):
                self._resolve(inner, spaced)
            if after := _missing({x for _, q in lines for x in q[1:]}, self.first):
                self._resolve(after, False)
            for p, q in lines:
                memo[p] = self.newline.join([memo[q[0]], *map(self.first.__getitem__, q[1:])])
        if rest:
            memo.update(zip(rest, self._direct([" " + x if spaced and self.kind == "bytes" else x for x in rest])))

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text. A memo over ``most`` pieces is emptied between calls."""
        if self.kind == "other":
            return [np.frombuffer(x, np.int32) for x in self._direct(texts)]
        for memo in (self.inner, self.first):
            if len(memo) > self.most:
                memo.clear()
        if self.kind == "words":
            cut = [("", _folded(x).split(" ")) for x in texts]
            self.inner[""] = b""
        else:
            cut = [cut_at_spaces(x) for x in texts]
        self.first[""] = b""
        if new := _missing({h for h, _ in cut}, self.first):
            self._resolve(new, False)
        found, gaps, new = [], [], set()
        for _, own in cut:
            got = list(map(self.inner.get, own))
            gap = [i for i, x in enumerate(got) if x is None] if None in got else ()
            new.update(own[i] for i in gap)
            found.append(got)
            gaps.append(gap)
        if new:
            self._resolve(new, True)
        for (_, own), got, gap in zip(cut, found, gaps):
            for i in gap:
                got[i] = self.inner[own[i]]
        return [np.frombuffer(self.first[head] + b"".join(got), np.int32) for (head, _), got in zip(cut, found)]


def _folded(text: str) -> str:
    """What a tokenizer of lower-case words makes of ASCII anyway, so that fewer pieces differ."""
    if "<|" in text:  # special tokens are looked for as written
        return text.replace("\n", " ")
    return text.replace("\n", " ").encode().lower().decode()


def _missing(pieces: set[str], memo: dict) -> list[str]:
    return list(filterfalse(memo.__contains__, pieces))


def cut_at_spaces(text: str) -> tuple[str, list[str]]:
    """What comes before the first cut, and the pieces after it without their leading space."""
    if not _RUN.search(text):
        head, *rest = text.split(" ")
        return head, rest
    own = _CUT.split(text)
    if own[0].startswith(" "):
        return "", [x[1:] for x in own]
    return own[0], [x[1:] for x in own[1:]]
