"""What a part listing states about its product: series word and number, nominal size, and the wordings of its worded
places (kind of part, material, connection), found with a vocabulary that the listings themselves teach.

No wording is listed here.  Sellers label many of their statements (``Material: Bronze``); a wording that stands behind
a label in some listings is recognised without one in the others.  Labels that mostly stand before the same wordings
name the same place, and a place counts if nearly every listing states it (``places``).
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from partmill.functions.quantities import FRACTION_SIGNS, Reader, base_value

# Words that may stand before a series number without being the series word.
NO_SERIES = set("series a an the as in by from with for of and to at comes supplied this model line number no item part rev revision size type material connection mm cm in inch inches".split())
TOKEN = re.compile(r"[^\W\d_]+|\d+")
CAMEL = re.compile(r"(?<=[a-zß-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ])")
LABELLED = re.compile(r"^\s*([^:=]{2,40}?)\s*[:=]\s*(.+)$", re.S)
#: A number of three or more digits is no part of a mixed fraction behind it.
LONG_NUMBER = re.compile(rf"(\d{{3,}})\s+(?=\d+\s?/\d|[{FRACTION_SIGNS}])|(?<=\bin)\s+(?=\d)", re.I)
#: Blanks that a reformatted copy has inside a number.
TORN = re.compile(r"(?<=\d)\s*([/⁄])\s*(?=\d)|(?<=\d)\s*(-)\s*(?=\d+\s*[/⁄]\s*\d)|(?<=\d)\s+(\.)\s*(?=\d)|(?<=\d)\s*(\.)\s+(?=\d)")
#: Nominal sizes beyond this (24 inches, in nm) are taken for other numbers with a quotation mark behind them.
LARGEST = 24 * 25_400_000
#: A whole field that is a length, with the usual spellings of millimetres and inches.
LENGTH = rf"^[\s\W]*[0-9{FRACTION_SIGNS}][0-9{FRACTION_SIGNS}\s./⁄,-]*\s*(?:mm|cm|in|inch|inches|[\"”″])\W*$"
#: The phrase that stands for all lengths, and the place that holds it.
LENGTHS = "#"


def tokens(text: str) -> list[str]:
    """Words and numbers in lower case; words glued together by their capitals are parted."""
    return [t.lower() for t in TOKEN.findall(CAMEL.sub(" ", text))]


def plain(text: str) -> str:
    """Letters and digits, case folded."""
    return "".join(c for c in (text or "").upper().lower() if c.isalnum())


class Facets:
    """Reads listings with a vocabulary.

    phrases: wording in letters and digits -> place; labels: label in letters and digits -> place.
    """

    def __init__(self, phrases: dict[str, str], labels: dict[str, str], size: str = ""):
        self.phrases, self.labels, self.size_place = phrases, labels, size
        self.longest = max(map(len, phrases), default=0)
        self.reader = Reader()
        self.scan = lru_cache(1 << 16)(self._scan)  # most fields come again and again
        self.place_of = lru_cache(1 << 14)(lambda label: labels.get(plain(label), ""))

    def size(self, text: str) -> tuple[str, str]:
        """The first length stated, in micrometres, and the text with the lengths blanked out."""
        text = TORN.sub(lambda m: m[m.lastindex], text)
        text = LONG_NUMBER.sub(lambda m: f"{m[1] or ''} | ", text)
        found, out, at = "", [], 0
        for item in self.reader.items(text):
            if item["unit"] and item["unit"][0] == "length" and 0 < (nm := base_value(item["value"], *item["unit"][1:])) <= LARGEST:
                if not found:
                    found = str(nm // 1000)
                out.append(text[at : item["start"]] + " | ")
                at = item["end"]
        return found, "".join(out) + text[at:]

    def phrase_at(self, words: list[str], i: int) -> tuple[str, int] | None:
        """The longest known wording that begins at a word, however its words are parted, and how many words it takes."""
        run, best = "", None
        for j in range(i, len(words)):
            run += words[j]
            if len(run) > self.longest:
                break
            if run in self.phrases:
                best = run, j + 1 - i
        return best

    def _scan(self, text: str) -> tuple[tuple[tuple[str, str], ...], tuple[str, ...]]:
        """((place, wording) stated, other words) of one field."""
        found: list[tuple[str, str]] = []
        size, text = self.size(text)
        if size:
            found.append(("size", size))
        words = tokens(text.replace("|", " † "))
        kept: list[str | None] = []
        i = 0
        while i < len(words):
            hit = self.phrase_at(words, i)
            if hit:
                found.append((self.phrases[hit[0]], hit[0]))
                kept.append(None)
            else:
                kept.append(words[i])
            i += hit[1] if hit else 1
        for i, word in enumerate(kept):
            if word and word.isdecimal() and len(word) >= 3:
                before = [w for w in kept[max(0, i - 2) : i] if w != "series"][-1:] or [None]
                after = [w for w in kept[i + 1 : i + 3] if w != "series"][:1] or [None]
                name = next((w for w in (before[0], after[0]) if w and not w.isdecimal() and len(w) > 2 and w not in NO_SERIES), None)
                if name:
                    found.append(("series", f"{name} {word}"))
                    break
        return tuple(found), tuple(w for w in kept if w and w not in NO_SERIES)

    def take(self, text: str, place: str, out: dict[str, str], rest: list[str]) -> None:
        """Takes what ``text`` states; what is stated first counts.  Behind the label of a place, a wording that is not
        in the vocabulary is that place's too."""
        found, words = self.scan(text)
        for name, value in found:
            out.setdefault(name, value)
        if place and place != self.size_place and place not in out and (unknown := plain(text)):
            out[place] = unknown
        else:
            rest += words

    def read(self, series: str | None, description: str | None, attributes: dict | None) -> tuple[dict[str, str], list[str]]:
        """(wordings by place, other words).  Labelled statements come before free text."""
        out: dict[str, str] = {}
        rest: list[str] = []
        normal = lambda s: unicodedata.normalize("NFC", s or "").replace("‑", "-").replace("‐", "-").replace("–", "-")
        for label, value in (attributes or {}).items():
            if value and plain(value) and (place := self.place_of(label or "")):
                self.take(normal(value), place, out, rest)
            elif value and not self.phrases:  # nothing was learned: all words count
                self.take(normal(value), "", out, rest)
        if series:
            self.take(normal(series), "", out, rest)
        fields = [f for f in re.split(r"[,;|]", normal(description)) if f.strip()]
        labelled = [m for f in fields if (m := LABELLED.match(f))]
        for m in labelled:
            self.take(m[2].strip(), self.place_of(m[1]), out, rest)
        for field in fields:
            if not LABELLED.match(field):
                self.take(field.strip(), "", out, rest)
        return out, rest
