"""Undoing deliberate misspelling: the likeliest plain word behind leetspeak, masking, spacing and repetition.

A disguised word is a lattice: each written character may stand for some letters, or for none. The best path under a
character trigram model, with a bonus for words the corpus has, is the restored word (an exact Viterbi search). A word of
plain letters that the corpus does not have may be one slip of the hand away from a word that matters.
"""

from __future__ import annotations

import math
import re
import unicodedata
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from itertools import product

#: What a character may stand for, besides itself. Fixed values.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i", "¢": "c", "&": "a"}
#: Letters of other scripts that look like Latin ones. Fixed values.
LOOKALIKES = dict(zip("абвгдеёзіїјкмнопрстухѕԁһԛԝαβεικνορτυχ", "abbrдeeзiijkmhoпpcтyxsdhqwaбeiknoptux", strict=True))
LOOKALIKES.update({"α": "a", "β": "b", "г": "r", "д": "d", "з": "z", "п": "n", "т": "t", "ѵ": "v", "ɡ": "g", "ı": "i"})
_HIDDEN = re.compile("[­͏؜ᅟᅠ឴឵᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_SEPARATORS = set(" .-_·•,/\\'`~")
_ANY = set("*#%?")
_ONE = r"(?:[^\W_]|[@$!*#])"
_SPACED = re.compile(rf"(?<![^\W_])(?<![^\W_]['’]){_ONE}([ .\-_·•*~]{{1,2}}){_ONE}(?:\1{_ONE})+(?![^\W_])")
_WORD = re.compile(r"[^\W\d_]{2,}")
_PLAIN_WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
_KEEP = re.compile(r"(?:user_?\d+|[\d.,:/%+\-]+|[\w.\-]+@[\w\-]+\.[\w.\-]+)", re.I)
_NUMBERED = re.compile(r"([^\W\d_]+)(\d{1,4})")
_BLANK = re.compile(r"(\s+)")
_TRIPLE = re.compile(r"(.)\1\1")
_MAY_SPACE = re.compile(r"(?<![^\W_])[^\W_][ .\-_·•*~]{1,2}[^\W_][ .\-_·•*~]")
_ENDS = re.compile(r"([^\w@$*#]*)(.*?)([^\w@$*#€£]*)", re.S)
#: Letters of a word from which one slip of the hand is looked for.
SLIP_FROM = 5


def tidy(text: str) -> str:
    """Lower case, compatibility forms and look-alike letters resolved, invisible characters dropped."""
    if text.isascii():
        return text.lower()
    t = _HIDDEN.sub("", unicodedata.normalize("NFKC", text)).lower()
    if t.isascii():
        return t
    out = []
    for word in re.split(r"(\s+)", t):
        latin = any("a" <= c <= "z" for c in word)
        out.append("".join(LOOKALIKES.get(c, c) for c in word) if latin else word)
    return "".join(out)


def _without_one(word: str) -> set[str]:
    return {word[:i] + word[i + 1 :] for i in range(len(word))}


def _one_slip(a: str, b: str) -> bool:
    """Whether one letter more, less or another, or two neighbours changed round, makes one word of the other."""
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    x, y = a[n:], b[n:]
    return x != y and (x[1:] == y or x == y[1:] or x[1:] == y[1:] or (x[:2] == y[1::-1] and x[2:] == y[2:]))


def word_counts(texts: Iterable[str]) -> Counter[str]:
    """Words of the texts that hold no spaced-out word, with their counts. Counts of parts of the texts add up."""
    words: Counter[str] = Counter()
    for t, n in Counter(texts).items():
        low = tidy(t)
        if not _SPACED.search(low):
            found = _WORD.findall(low)
            words.update(found if n == 1 else {w: c * n for w, c in Counter(found).items()})
    return words


class Restorer:
    """The character model and word counts of some texts, or of the words counted beforehand.

    ``lexicon`` has words that one slip of the hand (a letter more, less, another, or two changed round) may also stand for.
    """

    def __init__(self, texts: Iterable[str], extra: list[str] = (), counts: dict[str, int] | None = None, lexicon: Iterable[str] = ()):
        words = word_counts(texts)
        words.update(counts or {})
        words.update({w: 3 for x in extra for w in _WORD.findall(tidy(x))})
        self.words = {w: c for w, c in words.items() if c > 1 and not _TRIPLE.search(w)}
        self.sorted = sorted(self.words)
        three: Counter[str] = Counter()
        two: Counter[str] = Counter()
        for w, c in self.words.items():
            c = 1 + math.log(c)
            p = f"^^{w}$"
            for i in range(2, len(p)):
                three[p[i - 2 : i + 1]] += c
                two[p[i - 2 : i]] += c
        one: Counter[str] = Counter()
        for g, c in three.items():
            one[g[2]] += c
        total = sum(one.values()) or 1.0
        self.letters = "".join(sorted(c for c in one if c != "$"))
        self.floor = {c: math.log((one[c] + 0.5) / (total + 30)) - 3.0 for c in self.letters + "$"}
        self.three = {g: math.log(0.9 * c / two[g[:2]] + 0.1 * one[g[2]] / total) for g, c in three.items()}
        self.slips: dict[str, set[str]] = {}  # of a word, and of a word without one letter, the words of the lexicon
        for w in {w for x in [*lexicon, *extra] for w in _WORD.findall(tidy(x)) if len(w) >= SLIP_FROM}:
            for k in (w, *_without_one(w)):
                self.slips.setdefault(k, set()).add(w)
        self.seen: dict[str, str] = {}
        self.pieces: dict[str, str] = {}

    def _step(self, state: str, c: str) -> float:
        p = self.three.get(state + c)
        return p if p is not None else self.floor.get(c, -12.0)

    def _options(self, written: str, i: int) -> list[tuple[str, float]]:
        """Letters a written character may stand for with their log weight; '' means none."""
        c = written[i]
        if c in _ANY:
            return [("", -2.0), *((x, -2.2) for x in self.letters)]
        out = [(x, -0.3 if len(LEET[c]) == 1 else -0.8) for x in LEET.get(c, "")]
        if c.isalpha():
            out.append((c, 0.0))
            if i and written[i - 1] == c:
                out.append(("", -0.6 if i > 1 and written[i - 2] == c else -2.5))
        elif c in _SEPARATORS or c in "|!(&+":
            out.append(("", -0.2 if c in _SEPARATORS else -2.0))
        elif c.isdigit() and not out:
            out.append(("", -4.0))
        return out or [("", -3.0)]

    def _begins(self, head: str) -> bool:
        """Whether a known word begins so."""
        i = bisect_left(self.sorted, head)
        return i < len(self.sorted) and self.sorted[i].startswith(head)

    def decode(self, written: str) -> str:
        """The best reading of one written word: a known word, or the word as it is where no known one is the likeliest.

        An exact Viterbi search twice: over readings that begin known words (a beginning is a state, and holds the two letters the
        character model looks at), and over all readings with the last two letters as state, which the known word must match.
        """
        known: dict[str, float] = {"": 0.0}
        for i in range(len(written)):
            new: dict[str, float] = {}
            for letter, cost in self._options(written, i):
                for head, score in known.items():
                    s, h = score + cost, head
                    if letter:
                        h = head + letter
                        if h not in new and not self._begins(h):
                            continue
                        s += self._step(("^^" + head)[-2:], letter)
                    if new.get(h, -1e9) < s:
                        new[h] = s
            known = new
            if not known:
                return written
        ends = [(s + self._step(("^^" + w)[-2:], "$") + 6.0 + 0.4 * math.log(self.words[w]), w) for w, s in known.items() if w in self.words]
        if not ends:
            return written
        best, word = max(ends)
        free: dict[str, float] = {"^^": 0.0}
        for i in range(len(written)):
            new = {}
            for letter, cost in self._options(written, i):
                for state, score in free.items():
                    s, k = (score + cost + self._step(state, letter), state[1] + letter) if letter else (score + cost, state)
                    if new.get(k, -1e9) < s:
                        new[k] = s
            free = new
        return word if best >= max(s + self._step(k, "$") for k, s in free.items()) else written

    def slip(self, written: str) -> str | None:
        """The commonest word of the lexicon that is one slip away, None without one."""
        near = {w for k in (written, *_without_one(written)) for w in self.slips.get(k, ()) if _one_slip(written, w)}
        return max(near, key=lambda w: (self.words.get(w, 0), w)) if near else None

    def word(self, written: str) -> str:
        """A written word restored if it is disguised and a known word comes out, else as it is."""
        hit = self.seen.get(written)
        if hit is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            hit = written
            if written not in self.words and any(c.isalpha() for c in written):
                found = self.decode(written)
                if found in self.words and len(found) > 2:
                    hit = found
            self.seen[written] = hit
        return hit

    def _numbered(self, letters: str, digits: str) -> str | None:
        """The commonest known word of letters with every digit behind them read as one, as names with a number are many."""
        found = [w for w in ("".join([letters, *x]) for x in product(*[LEET.get(d, "") for d in digits])) if len(w) > 2 and w in self.words]
        return max(found, key=lambda w: (self.words[w], w)) if found else None

    def _joined(self, m: re.Match) -> str:
        """Single letters put together again; a first letter that is a word of its own stays apart."""
        w = re.sub(r"[ .\-_·•~]", "", m[0])
        found = self.word(w)
        if found not in self.words and " " in m[1] and len(w) > 3:
            rest = self.word(w[1:])
            if rest in self.words:
                return f"{w[0]} {rest}"
        return found

    def _token(self, w: str) -> str:
        """One blank-separated piece of a text: its ends are punctuation, its middle is restored where it is no plain word."""
        ends = _ENDS.fullmatch(w)
        head, body, tail = (ends[1], ends[2], ends[3]) if ends else ("", w, "")
        if _PLAIN_WORD.fullmatch(body):
            if _TRIPLE.search(body):
                return head + self.word(body) + tail
            return head + (self.slip(body) or body) + tail if len(body) >= SLIP_FROM - 1 and body.isalpha() and body not in self.words else w
        if _KEEP.fullmatch(body) or not any(c.isalpha() for c in body) or "..." in body:
            return w
        numbered = None if _TRIPLE.search(body) else _NUMBERED.fullmatch(body)
        if numbered:
            return head + (self._numbered(*numbered.groups()) or body) + tail
        found = self.word(body)
        if found == body and tail[:1] in ("!", "*", "$", "@") and self.word(body + tail[0]) != body + tail[0]:
            return head + self.word(body + tail[0]) + tail[1:]
        return head + found + tail

    def restore(self, text: str) -> str:
        """The text in lower case with its disguised words restored."""
        t = tidy(text)
        t = _SPACED.sub(self._joined, t) if _MAY_SPACE.search(t) else t
        out = []
        for w in _BLANK.split(t):
            if len(w) < 3 or w in self.words:
                out.append(w)
                continue
            hit = self.pieces.get(w)
            if hit is None:
                if len(self.pieces) > 100_000:
                    self.pieces.clear()
                hit = self.pieces[w] = self._token(w)
            out.append(hit)
        return "".join(out)
