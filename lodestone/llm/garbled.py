"""Text that was read in the wrong encoding: found span by span and restored.

For every pair of intended and mistaken encoding the garbled form of each likely
character is computed beforehand. One multi-pattern automaton finds these forms;
only the matched spans are replaced, so sound text beside them stays as it is.
"""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table, worker_cache

#: Encodings that UTF-8 bytes are mistaken for.
MISTAKEN = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251")
#: (intended, mistaken) pairs of one-byte encodings.
SWAPPED = (("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"))
LOST = "�"
#: Where characters that are no letters stand in sound text, by what they are; X is how the character is seen.
CONTEXTS = {
    "«“‘": r"(?<!\S)X(?=\w)", "»”": r"(?<=[\w.,!?…])X(?!\w)", "¿¡": r"(?<!\S)X(?=\w)", "°": r"(?<=\d)X(?=[CF]\b|\s|$)", "±": r"(?<=[\dCF\s])X(?=\s?\d)",
    "¼½¾": r"(?<!\S)X(?=\s)", "ºª": r"(?<=\d)X(?!\w)", "€£": r"(?<=\d )X(?!\w)|(?<!\S)X(?=\d)", "–—": r"(?<= )X(?= )", "…": r"(?<=\w)X(?!\w)",
}
# What follows a one-letter word with an accent in French, Portuguese, Spanish and Italian.
AFTER_ONE = "la le les l un une des du de ce cette mon ma mes son sa ses notre nos votre vos leur leurs o a os as um uma muito que el los las il lo gli".split()
_REFERENCE = re.compile(r"&(?:#[0-9]{2,7}|#[xX][0-9a-fA-F]{2,6}|[A-Za-z]{2,8}[0-9]?);")
_QUOTES = {"“": "”", '"': '"', "«": "»", "„": "“", "‘": "’", "`": "`", "'": "'"}


def _misread(data: bytes, encoding: str) -> str | None:
    """Bytes decoded as browsers do: undefined cp1252 bytes stay control characters."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(encoding))
        except UnicodeDecodeError:
            if encoding != "cp1252":
                return None
            out.append(chr(b))
    return "".join(out)


def likely() -> dict[str, bool]:
    """Characters whose garbled forms are looked for; whether one form alone is evidence."""
    sure = [*range(0xA0, 0x180), *range(0x2010, 0x2040), 0x20AC, 0x2122, 0x2116, 0x2212]
    more = [*range(0x370, 0x500), *range(0x5D0, 0x5EB), *range(0x620, 0x6D4), *range(0x3000, 0x3100), *range(0xFF00, 0xFF60)]
    return {chr(c): True for c in sure} | {chr(c): False for c in more}


def garbled_forms() -> dict[str, tuple[str, str, bool]]:
    """Garbled form -> (original, kind, sure). Twice garbled forms and whole CJK blocks included."""
    forms: dict[str, tuple[str, str, bool]] = {}

    def add(form: str | None, original: str, kind: str, sure: bool) -> None:
        if form and form != original and not form.isascii() and form not in forms:
            forms[form] = (original, kind, sure)

    for char, sure in likely().items():
        for wrong in MISTAKEN:
            once = _misread(char.encode("utf-8"), wrong)
            add(once, char, f"utf-8 as {wrong}", sure)
        for wrong in ("cp1252", "latin-1"):
            once = _misread(char.encode("utf-8"), wrong)
            for second in ("cp1252", "latin-1"):
                add(_misread(once.encode("utf-8"), second), char, f"utf-8 as {wrong}, twice", sure)
    return forms


def swapped_letters() -> dict[str, list[tuple[str, str]]]:
    """A character that stands for a letter after a swap of one-byte encodings -> (letter, kind)."""
    out: dict[str, list[tuple[str, str]]] = {}
    for right, wrong in SWAPPED:
        for code in [*range(0xC0, 0x100)]:
            letter = chr(code)
            if not letter.isalpha():
                continue
            try:
                seen = _misread(letter.encode(right), wrong)
            except UnicodeError:
                continue
            if seen and seen != letter and not seen.isascii():
                out.setdefault(seen, []).append((letter, f"{right} as {wrong}"))
    return out


class Mender:
    """Finds and undoes garbled spans in one text at a time."""

    def __init__(self):
        import ahocorasick

        self.forms = garbled_forms()
        self.swaps = swapped_letters()
        self.automaton = ahocorasick.Automaton()
        for form in self.forms:
            self.automaton.add_word(form, len(form))
        self.automaton.make_automaton()
        heads = {f[0] for f in self.forms}
        self.suspects = re.compile("[" + re.escape("".join(sorted(heads | set(self.swaps) | set(map(chr, range(0x2500, 0x25A0))) | {LOST}))) + "]")
        # A wrong character inside a word of Latin letters. Letters that words of these languages have there are no sign.
        natural = set("àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ’‘“”„‚‹›'·-–—…°ªºˆ")
        odd = "".join(sorted(c for c in self.swaps if c not in natural))
        # Marks that sound text has beside words, but not between two lower-case letters. Dashes, dots and apostrophes it has there too.
        self.marks = set("„”‚ˆ") & set(self.swaps)
        latin = "A-Za-zÀ-ÖØ-öø-ÿ"
        self.word = re.compile(f"[{latin}{re.escape(''.join(sorted(self.swaps)))}]+")
        self.odd = set(odd)
        lower = "a-zß-öø-ÿ"
        alone = "".join(map(chr, range(0x2550, 0x25A0))) + "αβγδεφπστ∙∞≈≡√"
        self.oddity = re.compile(f"(?<=[{lower}])[{re.escape(odd)}]|[{re.escape(odd)}](?=[{lower}])|[{alone}]|(?<=[a-z])[{''.join(sorted(self.marks))}](?=[a-z])")
        self.latin = re.compile(f"[{latin}]")
        self.strong = {c for c in self.odd if ord(c) >= 0x370 and ord(c) < 0x2000 or 0x2190 <= ord(c) < 0x25FF or c == "ⁿ"}
        self._learn_signs()
        self.run = re.compile(r"[^\x00-\x7f]{4,}")
        self.old_cyrillic = re.compile(r"(?<![A-Za-z])[à-ÿÀ-Ö]{4,}(?![A-Za-z])")

    def _learn_signs(self) -> None:
        """What tells a one-byte swap outside words: characters that sound text does not have where others belong.

        For each pair of encodings the places of quotes, signs and one-letter words are taken from what
        the character was. Box drawing, blocks and Greek letters there are a sign by themselves, if no other of their kind is
        near; the other characters of the same pair count beside such a sign.
        """
        self.signs, self.beside, self.strange = {}, {}, {}
        for right, wrong in SWAPPED:
            strange, usual, chars_ = [], [], set()
            for code in range(0x80, 0x100):
                try:
                    was = bytes([code]).decode(right)
                except UnicodeDecodeError:
                    continue
                seen = _misread(bytes([code]), wrong)
                if not seen or seen == was or seen.isascii():
                    continue
                x = re.escape(seen)
                before = len(strange)
                boxes = "─" <= seen <= "▟"
                greek = "Ͱ" <= seen <= "Ͽ" or unicodedata.category(seen) == "Sm" and seen not in "±×÷¬"
                for chars, place in CONTEXTS.items():
                    if was in chars:
                        (strange if boxes else usual).append(rf"(?<![─-▟]){place.replace('X', x)}(?![─-▟])" if boxes else place.replace("X", x))
                if was.isalpha() and was.islower() and greek:
                    strange += [rf"(?<=[a-z][a-z]){x}(?![\w])", rf"(?<!\w){x}(?= (?:{'|'.join(AFTER_ONE)})\b)", *([rf"(?<=[A-Za-z]){x}(?=\s)"] if not seen.isalpha() else [])]
                elif was.isalpha() and was.islower() and not seen.isalpha():
                    usual.append(rf"(?<!\w){x}(?=[a-z]{{2}})")
                if len(strange) > before:
                    chars_.add(seen)
            self.strange[right, wrong] = re.compile("[" + re.escape("".join(sorted(chars_))) + "]") if chars_ else None
            self.signs[right, wrong] = re.compile("|".join(strange)) if strange else None
            self.beside[right, wrong] = re.compile("|".join(strange + usual)) if strange else None

    def _signs(self, text: str, pair: tuple, beside: bool = False) -> list[tuple[int, int, str, str]]:
        right, wrong = pair
        rx = (self.beside if beside else self.signs)[pair]
        if not rx or not self.strange[pair].search(text):
            return []
        out = []
        for m in rx.finditer(text):
            try:
                out.append((m.start(), m.end(), m.group().encode(wrong).decode(right), f"{right} as {wrong}"))
            except UnicodeError:
                pass
        return out

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """Garbled spans ``(start, end, original, kind)`` in order, longest forms first."""
        found = []
        for last, length in self.automaton.iter(text):
            found.append((last - length + 1, last + 1))
        found.sort(key=lambda s: (s[0], -s[1]))
        out, reach = [], 0
        for s, e in found:
            if s < reach:
                continue
            out.append((s, e))
            reach = e
        kept, unsure = [], []
        for k, (s, e) in enumerate(out):
            original, kind, sure = self.forms[text[s:e]]
            beside = (k > 0 and out[k - 1][1] == s) or (k + 1 < len(out) and out[k + 1][0] == e)
            (unsure if self._sound(text, s, e, sure, beside) else kept).append((s, e, original, kind))
        if kept and unsure:
            # Signs that stand alone are garbled where the same mistake is seen elsewhere in the text.
            kinds = {x[3] for x in kept}
            kept += [x for x in unsure if x[3] in kinds and not x[2].isalpha()]
            kept.sort()
        return kept

    @staticmethod
    def _sound(text: str, s: int, e: int, sure: bool, beside: bool) -> bool:
        """Whether a form may be ordinary text where it stands."""
        form, before, after = text[s:e], text[s - 1 : s], text[e : e + 1]
        if not sure:
            return not beside
        head, tail = form[0], form[-1]
        if head in "ÃÂ" and len(form) == 2 and tail in "‘’“”–—…‚„  ":
            # An upper-case word may end in such a letter before a quote, a dash or a blank.
            return not after.isalpha() if tail != " " else before.isupper()
        if "Ѐ" <= head <= "ӿ":
            # Two Cyrillic letters are garbled Latin only inside a Latin word; a letter and a sign not inside a Cyrillic one.
            if form.isalpha():
                return not any(c.isascii() and c.isalpha() or "À" <= c <= "ÿ" for c in (before, after))
            return any("Ѐ" <= c <= "ӿ" for c in (before, after)) and not beside
        if "─" <= head <= "╿":
            return any("─" <= c <= "╿" for c in (before, after)) and not beside
        return False

    def swapped(self, text: str) -> list[tuple[int, int, str, str]]:
        """Words with a letter misread between one-byte encodings, with the word restored."""
        if not self.oddity.search(text):
            return []
        votes: dict[str, list] = {}
        usual: dict[str, int] = {}
        strong = False
        for m in self.word.finditer(text):
            word = m.group()
            inner = [i for i, c in enumerate(word) if c in self.odd or c in self.marks and word[i - 1 : i].islower() and word[i + 1 : i + 2].islower()]
            if not inner or len(word) - len(inner) < 3:
                continue
            good = []
            for i in inner:
                left, right = word[:i], word[i + 1 :]
                near = sum(c.isascii() for c in left[-2:] + right[:2])
                flanked = left[-1:].islower() and (right[:1].islower() or not right) or (not left and len(right) > 2 and right[:3].islower())
                if flanked and near >= 2 and not (word[i].isupper() and not left):
                    good.append(i)
            if not good:
                continue
            strong = strong or any(word[i] in self.strong or self._misplaced(word, i) for i in good)
            for i in good:
                for letter, kind in self.swaps[word[i]]:
                    if letter.islower():
                        votes.setdefault(kind, []).append(m.start())
                        usual[kind] = usual.get(kind, 0) + (word[i + 1 : i + 2] == "o" if letter == "ã" else word[i + 1 : i + 2] == "e" if letter == "õ" else letter in "äöüßéèêàçñáíóú" and letter + word[i + 1 : i + 2] != "äo")
        if not votes or not strong and max(map(len, votes.values())) < 2:
            best = max(SWAPPED, key=lambda pair: len(self._signs(text, pair)))
            return self._signs(text, best, True) if self._signs(text, best) else []
        kind = max(votes, key=lambda k: (len(votes[k]), usual[k], -[f"{a} as {b}" for a, b in SWAPPED].index(k)))
        back = {seen: letter for seen, pairs in self.swaps.items() for letter, k in pairs if k == kind}
        starts = set(votes[kind])
        out = []
        for m in self.word.finditer(text):
            word = m.group()
            hit = m.start() in starts
            # Beside words that are surely garbled, the same characters inside or beside a word are garbled too.
            if hit or any(c in back and c in self.odd for c in word) and any(c.isascii() for c in word):
                mended = "".join(back.get(c, c) for c in word)
                if mended != word:
                    out.append((m.start(), m.end(), mended, kind))
        pair = next(p for p in SWAPPED if kind == f"{p[0]} as {p[1]}")
        out += [x for x in self._signs(text, pair, bool(self._signs(text, pair))) if not any(a < x[1] and x[0] < b for a, b, *_ in out)]
        return sorted(out)

    def _misplaced(self, word: str, i: int) -> bool:
        """Whether sound words cannot have such a character there: one is evidence then."""
        left, right = word[:i], word[i + 1 :]
        if word[i] in self.marks or "\x80" <= word[i] <= "\x9f":
            return left[-1:].islower() and right[:1].islower()
        return word[i].isupper() and len(left) > 1 and left.islower() and (not right or right.islower())

    def quoted(self, text: str, s: int, e: int) -> bool:
        """Whether a span lies in a single quoted word."""
        left = s
        while left > 0 and not text[left - 1].isspace() and text[left - 1] not in _QUOTES and s - left < 40:
            left -= 1
        right = e
        closing = _QUOTES.get(text[left - 1 : left])
        if not closing:
            return False
        while right < len(text) and not text[right].isspace() and text[right] != closing and right - e < 40:
            right += 1
        return text[right : right + 1] == closing

    def _unescaped(self, text: str) -> tuple | None:
        """Text whose garbled characters were written as character references; None if it has no such."""
        pieces, origin, at, size = [], {}, 0, 0
        for m in _REFERENCE.finditer(text):
            char = html.unescape(m.group())
            if len(char) != 1 or char.isascii():
                continue
            pieces += [text[at : m.start()], char]
            size += m.start() - at
            origin[size] = m.group()
            size += 1
            at = m.end()
        if not origin:
            return None
        plain = "".join([*pieces, text[at:]])
        spans = [x for x in self.spans(plain) if not self.quoted(plain, x[0], x[1])]
        if not any(k in origin for s, e, *_ in spans for k in range(s, e)):
            return None
        out, at = [], 0
        for s, e, original, _ in [*spans, (len(plain), len(plain), "", "")]:
            out += [origin.get(k, plain[k]) for k in range(at, s)] if any(at <= k < s for k in origin) else [plain[at:s]]
            out.append(original)
            at = e
        kinds = [k for *_, k in spans]
        return True, "".join(out), len(spans) + plain.count(LOST), max(sorted(set(kinds)), key=kinds.count) + ", as references", LOST not in plain

    def mend(self, text: str | None) -> tuple[bool, str | None, int, str | None, bool]:
        """(garbled, restored text, spans, kind, whole): whole says that nothing was lost."""
        if text and "&" in text and (read := self._unescaped(text)):
            return read
        if not text or text.isascii() or not self.suspects.search(text):
            return False, text, 0, None, True
        lost = text.count(LOST)
        spans = self.spans(text)
        spans = [x for x in spans if not self.quoted(text, x[0], x[1])] if spans else []
        if not spans:
            spans = [(m.start(), m.end(), *back) for m in self.run.finditer(text) if (back := _recode(m.group()))]
        if not spans:
            spans = [x for x in self.swapped(text) if not self.quoted(text, x[0], x[1])]
        if not spans and not lost:
            hits = [m for m in self.old_cyrillic.finditer(text)]
            for m in hits:
                try:
                    spans.append((m.start(), m.end(), m.group().encode("latin-1").decode("cp1251"), "cp1251 as latin-1"))
                except UnicodeError:
                    pass
        if not spans and not lost:
            return False, text, 0, None, True
        out, at = [], 0
        for s, e, original, _ in spans:
            if s < at:
                continue
            out += [text[at:s], original]
            at = e
        kinds = [k for *_, k in spans]
        kind = max(sorted(set(kinds)), key=kinds.count) if kinds else "undecodable bytes"
        return True, "".join([*out, text[at:]]), len(spans) + lost, kind, not lost


def _recode(run: str) -> tuple[str, str] | None:
    """What a run of misread characters was, if its bytes are whole UTF-8: two characters of any script or an emoji."""
    for wrong in MISTAKEN:
        data = bytearray()
        for c in run:
            try:
                data += c.encode(wrong)
            except UnicodeEncodeError:
                if wrong != "cp1252" or ord(c) > 255:
                    data = None
                    break
                data.append(ord(c))
        try:
            original = data.decode("utf-8") if data else ""
        except UnicodeDecodeError:
            continue
        if len(original) >= 2 or original > "\uffff":
            return original, f"utf-8 as {wrong}"
    return None


def mended(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, garbled, restored, n_spans, kind, whole)`` for every row.

    Null, empty and sound texts come back unchanged with ``garbled`` false. A
    text is garbled if it holds a misread span outside a single quoted word, or
    a replacement character. ``restored`` has the spans undone; ``whole`` is false
    where bytes were lost and the text can be restored in part only.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        mender = worker_cache("mender", Mender)
        for batch in batches:
            rows = [mender.mend(t) for t in batch.column(text).to_pylist()]
            columns = list(zip(*rows)) if rows else [[]] * 5
            types = (pa.bool_(), pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array(list(c), t) for c, t in zip(columns, types))],
                                             names=[key, "garbled", "restored", "n_spans", "kind", "whole"])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}, garbled boolean, restored string, n_spans int, kind string, whole boolean")


def garbled_keys(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The keys of garbled rows only: texts go to the workers, but do not come back."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        mender = worker_cache("mender", Mender)
        for batch in batches:
            hit = pa.array([mender.mend(t)[0] for t in batch.column(text).to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(key).filter(hit)], names=[key])

    return df.select(key, text).mapInArrow(run, f"{key} {kind}")


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents whose text is garbled, wholly or in part."""
    return garbled_keys(table(spark, sf_dir, "documents"))


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every garbled document with its restored text."""
    return mended(table(spark, sf_dir, "documents")).filter("garbled").drop("garbled")


QUERIES = {"p10_found": p10_found, "p10_restored": p10_restored}
ORACLES: dict[str, str] = {}
