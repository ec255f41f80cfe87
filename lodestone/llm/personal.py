"""Personal information in free text: found, replaced by typed placeholders or by surrogates.

One automaton over the lower-cased text finds the anchors: signs of an e-mail
address, words of street names, words before a name, and the given and family names of a
gazetteer that is learned from the author column of the whole table. Around an anchor,
and around every cluster of digits, small patterns decide kind and extent.
"""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import cut, drop, scratch_path, table, worker_cache

KINDS = ("email", "phone", "id_number", "address", "name")
#: So many of the most frequent names go into the automaton; the others are looked up word by word in a table of hashes.
MOST_NAMES = 20_000

# Common given names, for the gender that a surrogate has to match.
FEMALE = "Adela Agnes Alice Amara Amelia Anna Astrid Beatriz Birgit Camille Carmen Charlotte Chiara Clara Claire Dagmar Delphine Diana Dorothy Elena Elisabeth Elodie Emilia Emma Eva Farida Fatima Freya Greta Hannah Helena Ines Ingrid Irene Isabel Jane Jasmin Jennifer Jessica Julia Karen Katrin Laura Leila Linda Linnea Lotte Lucia Margaret Maria Marta Mary Mireille Nadia Nancy Nicole Nora Olga Patricia Paula Priyanka Rachel Rosa Ruth Saoirse Sarah Selma Sofia Susan Tamsin Teresa Ulrika Ursula Vera Victoria Wilma Yara Yasmin Yvonne Zelda Ольга Марина Вера Анна Елена Ирина Наталья Татьяна Светлана Мария".split()
MALE = "Adam Adrian Ahmed Albert Alexander Andrew Anselm Anton Arthur Arvid Basil Benedikt Bruno Carlos Casimir Cedric Charles Conrad Daniel David Diego Edward Emil Erik Fabrizio Felix Frank George Gustav Hamza Henry Hugo Ivan Jack James Joaquin Johannes John Jonas Joseph Karim Kwame Leon Louis Luca Marek Martin Michael Nicholas Nils Omar Oskar Paul Pavel Pedro Peter Quentin Richard Robert Ruben Samuel Sebastian Stefan Thomas Tobias Tomas Torvald Ulrich Viktor Walter William Xavier Yannick Yusuf Zoran Павел Антон Илья Иван Дмитрий Сергей Алексей Николай Михаил Андрей".split()
# English words that are names too. Alone they are a name only with a neighbour that is one.
WORDS_TOO = set("april art august baker banks bell berry bill bird bishop black bond brook brooks brown bush butler carter chance chase church cook cooper crystal daisy dawn day dean drew faith field fields fisher ford fox frank gene gordon grace grant gray green hall harmony heath hill holly hope hunter iris ivy jack joy june justice king knight lane lily long love major mark marsh marshall mason may miller moon page park parks pat penny pierce pope porter price prince ray reed rich rivers robin rose ruby rusty short small star stone storm summer sunny taylor turner violet walker ward weaver west will wise wolf wood woods young".split())
# Syllables that surrogates are built of, by script.
HEADS = "Alder Bex Callo Dun Elling Farring Gal Hart Isle Jess Kirk Low Marrow Nether Oak Pem Quill Ravens Silver Thorn Under Vant Wester Yarrow Zimmer".split()
TAILS = "brand brook croft dale don field grove hale haven lund marsh mere mond moor ran ry wenn wick worth".split()
SCRIPTS = {
    "latin": ("bdfgklmnprstv", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αειοω"), "arabic": ("بتجدرسشفقكلمن", "اوي"),
    "hebrew": ("בגדזכלמנפרשת", "אוי"), "devanagari": ("कगचजतदनपबमरलस", "ािीुे"), "kana": ("カキクケコサシスセソタチツテト", "ナニヌネノマミムメモ"),
    "hangul": ("가나다라마바사아자차하", "강민서준지은영현수진"), "han": ("王李张刘陈杨黄赵周吴徐孙", "伟芳娜敏静丽强磊军洋勇艳杰明"),
}

# Words of addresses in the languages of the texts.
SUFFIX = "street st road rd avenue ave lane ln drive dr court ct way boulevard blvd place pl terrace close square sq crescent".split()
PREFIX = "rue allée allee avenue avenida calle chemin impasse boulevard place plaza paseo rua travessa via quai route camino largo passage".split()
GERMAN = "straße strasse weg gasse platz allee stieg steig kehre kamp deich ring damm ufer graben winkel pfad markt".split()
CUES = "signed|thanks to|ask for|contact|my manager|regards,|mr|mrs|ms|dr|mr.|mrs.|ms.|dr.|herr|frau|señor|señora|monsieur|madame".split("|")
STOP = set("a an the of in on at to for and or but with by from is was are it we i they you that this so than as not no one two per each every more most different easier only same other all any".split())

B = r"[\s​ *_]"
SEP = r"[\s​.\-]"
CLUSTER = re.compile(r"\d[\d\s​().\-]{5,}")
PHONES = [re.compile(p) for p in (
    rf"\+\d(?:[\s​.\-()]{{0,3}}\d){{8,13}}(?!\d)",
    rf"\(\d{{3}}\){SEP}{{0,3}}\d{{3}}{SEP}{{0,3}}\d{{4}}(?!\d)",
    rf"(?<![\w\-])(?:1{SEP}{{1,3}})?[2-9]\d{{2}}{SEP}{{1,3}}\d{{3}}{SEP}{{1,3}}\d{{4}}(?![\d\-])",
    rf"(?<![\w\-])0\d(?:{SEP}{{1,3}}\d\d){{4}}(?![\d\-])",
    rf"(?<![\w\-])07\d{{3}}{SEP}{{0,3}}(?:\d{{6}}|\d{{3}}{SEP}{{1,3}}\d{{3}})(?![\d\-])",
    rf"(?<![\w\-])(?:1[\s​]{{0,3}})?[2-9]\d{{2}}[\s​]{{0,3}}[2-9]\d{{6}}(?![\d\-])",
    rf"(?<![\w\-])0\d{{9}}(?![\d\-])",
)]
NUMBERS = [re.compile(p) for p in (
    rf"(?<![\w\-])\d{{3}}(?P<s>[\s​]{{1,3}}|-)\d{{2}}(?:(?P=s)|[\s​]{{1,3}}|-)\d{{4}}(?![\d\-])",
    r"(?<![\w\-])(?:000|666|9\d\d)\d{6}(?![\d\-])",
)]
NINO = re.compile(rf"(?<![A-Za-z])[A-Za-z]{{2}}[\s​]{{0,3}}\d{{2}}[\s​]{{0,3}}\d{{2}}[\s​]{{0,3}}\d{{2}}[\s​]{{0,3}}[A-Da-d](?![A-Za-z0-9])")
NUMBER_CUE = re.compile(r"(?i)(?:\bssn|social security|insurance no|tax number|tax id)\W{0,6}$")
LOCAL = re.compile(rf"[\w.+%\-]+$")
DOMAIN = re.compile(rf"{B}{{0,3}}([A-Za-z0-9\-]+(?:(?:\.|{B}{{0,3}}(?:\[dot\]|\(dot\)|\bdot\b){B}{{0,3}})[A-Za-z0-9\-]+)+)", re.I)
CAP = r"[A-ZÀ-ÖØ-Þ][\w'’]+(?:-[A-ZÀ-ÖØ-Þ][\w'’]+)?"
NAMED = re.compile(rf"{B}+({CAP}(?:{B}+[A-Z]\.?)?{B}+{CAP}|{CAP},{B}+{CAP})(?={B}*(?:[,(/.;:!?]|at\b|for\b|if\b|in\b|and\b|or\b|$))")
US = re.compile(rf"(\d{{1,5}}){B}+(?:(?:[NSEW]\.?|north|south|east|west){B}+)?((?:[\w'’.]+{B}+){{1,3}})$", re.I)
UNIT = re.compile(rf"\.?,?{B}*(?:(?:apt|unit|suite|ste|flat)\.?{B}*\d+\w?|#{B}*\d+)", re.I)
ROMANCE = re.compile(rf"(\d{{1,4}})(?:{B}?(?:bis|ter))?,?{B}+$")
ROMANCE_TAIL = re.compile(rf"{B}+(?:(?:de|del|des|du|la|le|les|las|los|da|do|dos|l'|d'){B}*){{0,2}}[\w'’]+(?:{B}+[\w'’]+)?")
GERMAN_HEAD = re.compile(rf"(?:(?:am|an der|im|zum|zur|auf dem){B}+)?(?:[\wäöüß]+{B}+)?[\wäöüß]*$", re.I)
GERMAN_TAIL = re.compile(rf"{B}+\d{{1,4}}{B}?[a-z]?(?![\w])", re.I)
_NAME_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
AUTHOR_NAME = re.compile(rf"^\s*(?:by\s+)?(?P<n>{CAP}(?:\s+[A-Z]\.?)?\s+{CAP}|{CAP},?\s+{CAP})(?:\s+\(\w+\))?\s*$")


def fold(s: str) -> str:
    """Lower case without accents, hyphens and apostrophes."""
    s = unicodedata.normalize("NFKD", s.lower())
    return "".join(c for c in s if c.isalnum())


def lowered(s: str) -> str:
    """Lower case, character by character, so that positions stay."""
    low = s.lower()
    return low if len(low) == len(s) else "".join(c.lower() if len(c.lower()) == 1 else c for c in s)


def learn_names(rows: DataFrame, least: int = 2) -> tuple[list[str], list[str], str | None]:
    """Given and family names of authors who sign with their name, seen ``least`` times over all rows.

    The ``MOST_NAMES`` most frequent of each are returned, which bounds what workers
    receive with their task. Where there are more, the others are written to the shared folder, by the
    hash of their folded form, and the path is the third value. An empty table has none.
    """
    cap = r"[\p{Lu}][\p{L}'’]+(?:-[\p{Lu}][\p{L}'’]+)?"
    a = F.regexp_replace(F.trim("author"), r"^(?i:by)\s+|\s+\(\p{L}+\)$", "")
    straight, turned = rf"^({cap})\s+(?:\p{{Lu}}\.?\s+)?({cap})$", rf"^({cap}),\s*({cap})$"
    parts = rows.filter("author is not null and author rlike '\\\\s'").select(a.alias("a"))
    named = parts.select(
        F.when(F.col("a").rlike(straight), F.struct(F.regexp_extract("a", straight, 1).alias("g"), F.regexp_extract("a", straight, 2).alias("f")))
        .when(F.col("a").rlike(turned), F.struct(F.regexp_extract("a", turned, 2).alias("g"), F.regexp_extract("a", turned, 1).alias("f"))).alias("n")
    ).filter("n is not null")
    seen = named.select(F.explode(F.array(F.struct(F.lit("g").alias("k"), F.initcap("n.g").alias("w")), F.struct(F.lit("f").alias("k"), F.col("n.f").alias("w")))).alias("x"))
    counted = cut(seen.groupBy("x.k", "x.w").count().filter(F.col("count") >= least), "names")
    out, least_kept = [], {}
    for kind in "gf":
        top = counted.filter(F.col("k") == kind).orderBy(F.desc("count"), "w").limit(MOST_NAMES).collect()
        out.append(sorted(r["w"] for r in top))
        least_kept[kind] = (top[-1]["count"], top[-1]["w"]) if len(top) == MOST_NAMES else None
    beyond = [
        (F.col("k") == kind) & ((F.col("count") < last[0]) | (F.col("count") == last[0]) & (F.col("w") > last[1])) for kind, last in least_kept.items() if last
    ]
    rest = counted.filter(beyond[0] if len(beyond) == 1 else beyond[0] | beyond[1]) if beyond else None
    return out[0], out[1], None if rest is None or rest.isEmpty() else _rest_of_names(rest)


def _rest_of_names(rest: DataFrame) -> str:
    """Write ``(k, w)`` as sorted hashes of folded names; eight bytes a name are what a worker holds of them."""

    def run(batches):
        for batch in batches:
            hashes = [_name_hash(fold(w)) for w in batch.column("w").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), batch.column("k")], names=["h", "k"])

    path = scratch_path(rest.sparkSession, "more-names")
    rest.select("k", "w").mapInArrow(run, "h bigint, k string").write.parquet(path)
    return path


def _name_hash(folded: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(folded) - 2**63


class _MoreNames:
    """The worker's side of the names that the automaton does not hold."""

    def __init__(self, path: str):
        import numpy as np
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        found = ds.dataset(root, filesystem=system, format="parquet").to_table()
        hashes, kinds = found.column("h").to_numpy(), np.asarray(found.column("k").to_pylist())
        self.tables = {k: np.sort(hashes[kinds == k]) for k in "gf"}

    def kind(self, word: str) -> str | None:
        import numpy as np

        h = _name_hash(fold(word))
        for k, table_ in self.tables.items():
            at = int(np.searchsorted(table_, h))
            if at < len(table_) and table_[at] == h:
                return k
        return None


class Finder:
    """Finds personal information in one string at a time."""

    def __init__(self, given: list[str], family: list[str], more: str | None = None):
        import ahocorasick

        self.more = _MoreNames(more) if more else None
        self.given = {fold(n) for n in given}
        self.family = {fold(n) for n in family} - self.given
        self.automaton = ahocorasick.Automaton()
        marks: dict[str, str] = {"@": "@", "(at)": "@", "[at]": "@", " dot ": "dot"}
        for w in CUES:
            marks[w + " "] = "cue"
        for w in SUFFIX:
            marks[" " + w] = "us"
        for w in PREFIX:
            marks[" " + w + " "] = "romance"
        for w in GERMAN:
            marks.setdefault(w + " ", "german")
        for names, kind in ((family, "f"), (given, "g")):
            for n in names:
                for form in {n.lower(), fold(n), n.lower().replace("-", ""), unicodedata.normalize("NFD", n.lower())}:
                    if len(form) > 2:
                        marks[form] = kind
        for form, kind in marks.items():
            self.automaton.add_word(form, (kind, len(form)))
        self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, str]]:
        """``(start, end, kind)`` in order of start, none overlapping another."""
        low = lowered(text)
        for odd in "\n\r\t ​   ":
            if odd in low:
                low = low.replace(odd, " ")
        hits = [(last - n + 1, last + 1, kind) for last, (kind, n) in self.automaton.iter(low)]
        out: list[tuple[int, int, str]] = []
        taken: list[tuple[int, int]] = []

        def free(s: int, e: int) -> bool:
            return all(e <= a or s >= b for a, b in taken)

        def take(s: int, e: int, kind: str) -> None:
            out.append((s, e, kind))
            taken.append((s, e))

        for s, e, kind in hits:
            if kind == "@" or kind == "dot":
                found = self._email(text, s, e, kind)
                if found and free(*found):
                    take(*found, "email")
        for m in CLUSTER.finditer(text):
            self._numbers(text, m.start(), m.end(), free, take)
        plain = text.islower() or sum(c.isupper() for c in text) > 0.6 * sum(c.isalpha() for c in text)
        for s, e, kind in hits:
            if kind in ("us", "romance", "german"):
                found = getattr(self, "_" + kind)(text, low, s, e, plain)
                if found and free(*found):
                    take(*found, "address")
        if self.more:
            hits = self._more_hits(text, hits, plain)
        self._names(text, low, hits, free, take, plain)
        out.sort()
        return out

    def _email(self, text, s, e, kind):
        if kind == "dot":
            m = re.search(rf"([\w.+%\-]+)\s+at\s+[\w\-]+\s*$", text[max(0, s - 80) : s], re.I)
            d = re.match(r"\s+dot\s+\w+", text[s : s + 30], re.I)
            return (max(0, s - 80) + m.start(1), s + d.end()) if m and d else None
        back = max(0, s - 70)
        head = text[back:s]
        m = LOCAL.search(head.rstrip() if e - s > 1 else head)
        d = DOMAIN.match(text, e)
        if not m or not d or not any(c.isalnum() for c in m.group()):
            return None
        lead = len(m.group()) - len(m.group().lstrip("._+%-*"))
        return back + m.start() + lead, d.end(1)

    @staticmethod
    def _numbers(text, s, e, free, take):
        lo, hi = max(0, s - 8), min(len(text), e + 6)
        part = text[lo:hi]
        for rx, kind in [*((p, "id_number") for p in (NINO, *NUMBERS)), *((p, "phone") for p in PHONES)]:
            for m in rx.finditer(part):
                a, b = lo + m.start(), lo + m.end()
                if free(a, b):
                    take(a, b, kind)
        for m in re.finditer(r"(?<![\w\-])\d{9}(?![\d\-])", part):
            a, b = lo + m.start(), lo + m.end()
            if free(a, b) and NUMBER_CUE.search(text[max(0, a - 40) : a]):
                take(a, b, "id_number")

    @staticmethod
    def _us(text, low, s, e, plain):
        if low[e : e + 1].isalnum():
            return None
        back = max(0, s - 48)
        m = US.search(text[back : s + 1])
        if not m or (m.start() + back > 0 and (text[back + m.start() - 1].isalnum() or text[back + m.start() - 1] in "-.")):
            return None
        words = [w for w in re.split(rf"{B}+", m.group(2)) if w]
        if any(w.lower().strip(".'’") in STOP or any(c.isdigit() for c in w) for w in words):
            return None
        if not plain and not (all(w[0].isupper() for w in words) and text[s + 1].isupper()):
            return None
        unit = UNIT.match(text, e)
        return back + m.start(), unit.end() if unit else e

    @staticmethod
    def _romance(text, low, s, e, plain):
        back = max(0, s - 10)
        m = ROMANCE.search(text[back : s + 1])
        if not m or (back + m.start() > 0 and (text[back + m.start() - 1].isalnum() or text[back + m.start() - 1] in "-.")):
            return None
        tail = ROMANCE_TAIL.match(text, e - 1)
        if not tail or not plain and not any(c.isupper() for c in tail.group()):
            return None
        return back + m.start(), tail.end()

    @staticmethod
    def _german(text, low, s, e, plain):
        tail = GERMAN_TAIL.match(text, e - 1)
        if not tail or tail.group().strip()[-1:].isalpha() and len(tail.group().strip()) > 5:
            return None
        back = max(0, s - 40)
        head = GERMAN_HEAD.search(text[back:e - 1])
        word = re.search(r"[\wäöüß]+$", text[back : e - 1])
        if not word or len(word.group()) <= e - 1 - s and not re.search(rf"(?i)\b(?:am|im|zum|zur|an der|auf dem){B}+[\wäöüß]+{B}+$", text[back : back + word.start()]):
            return None
        start = back + word.start()
        lead = re.search(rf"(?i)\b(?:am|im|zum|zur|an der|auf dem){B}+(?:[\wäöüß]+{B}+)?$", text[back:start])
        if lead:
            start = back + lead.start()
        if not plain and not text[start].isupper():
            return None
        return start, tail.end()

    def _more_hits(self, text, hits, plain):
        """The hits with words that are names beyond those of the automaton."""
        known = {(s, e) for s, e, _ in hits}
        for m in _NAME_WORD.finditer(text):
            if (plain or m.group()[0].isupper()) and m.span() not in known and (k := self.more.kind(m.group())):
                hits.append((m.start(), m.end(), k))
        return sorted(hits, key=lambda h: (h[1], h[0]))

    def _names(self, text, low, hits, free, take, plain):
        words = []
        for s, e, kind in hits:
            if kind in "gf" and (plain or text[s].isupper()) and not (low[s - 1 : s].isalnum() or low[s - 1 : s] in ("_", "@", "-") and s > 0) and not (low[e : e + 1].isalnum() or low[e : e + 1] in ("_", "@")) and free(s, e):
                while words and words[-1][0] >= s:
                    words.pop()
                if not words or words[-1][1] <= s:
                    words.append((s, e, kind))
        i = 0
        while i < len(words):
            s, e, kind = words[i]
            j = i
            while j + 1 < len(words) and j - i < 2:
                gap = text[e : words[j + 1][0]]
                if not re.fullmatch(rf"-|[,.]?{B}{{0,6}}(?:\w\.?{B}{{1,4}})?", gap) or words[j + 1][2] == words[j][2]:
                    break
                j += 1
                e = words[j][1]
            if j == i:
                # A given or family name alone: a person's if an unknown name beside it is written like one.
                after = re.match(rf",?{B}{{1,4}}(?:[A-Z]\.?{B}{{1,4}})?({CAP})", text[e:])
                if kind == "g" and after and text[s].isupper():
                    e += after.end()
                elif kind == "f":
                    before = re.search(rf"({CAP}){B}{{1,4}}(?:[A-Z]\.?{B}{{1,4}})?$", text[max(0, s - 30) : s])
                    after = re.match(rf",{B}{{1,4}}({CAP})", text[e:])
                    if after:
                        e += after.end()
                    elif before and text[s].isupper() and before.group(1).lower() not in STOP | {"signed", "manager", "contact", "reads", "thanks"}:
                        s = max(0, s - 30) + before.start()
            alone = s == words[i][0] and e == words[i][1] and j == i
            if free(s, e) and not (alone and fold(text[s:e]) in WORDS_TOO):
                take(s, e, "name")
            i = j + 1
        for s, e, kind in hits:
            if kind == "cue" and not (s and low[s - 1].isalnum()):
                m = NAMED.match(text, e - 1)
                if m and free(m.start(1), m.end(1)):
                    take(m.start(1), m.end(1), "name")

    def author(self, value: str) -> list[tuple[int, int, str]]:
        found = self.find(value)
        if not found:
            m = AUTHOR_NAME.match(value)
            if m:
                return [(m.start("n"), m.end("n"), "name")]
        return found


def canonical(kind: str, piece: str, given: set = frozenset()) -> str:
    """What all mentions of one entity have in common.

    A name is ``given|family``: the words of either, without initials. A single word is the part that
    ``given`` says; a part that is not written is empty. So a whole name and its parts agree.
    """
    low = piece.lower()
    if kind == "email":
        low = re.sub(r"\(at\)|\[at\]|\s+at\s+", "@", low)
        return re.sub(r"[\s​*]+", "", re.sub(r"\[dot\]|\(dot\)|\s+dot\s+", ".", low))
    if kind == "name":
        words = [fold(w) for w in re.split(r"[\s​ *_.]+", re.sub(r",", " , ", low)) if w]
        words = [w for w in words if len(w) > 1 or w == "" or not w.isascii()]
        if "" in words and words.index("") >= 1:
            at = words.index("")
            words = words[at + 1 :] + words[:at]
        words = [w for w in words if w]
        if len(words) == 1:
            return f"{words[0]}|" if words[0] in given else f"|{words[0]}"
        return f"{' '.join(words[:-1])}|{words[-1]}" if words else "|"
    return fold(piece)


def parts_of(kind: str, canon: str) -> list[tuple[str, str]]:
    """The entities that are drawn for: the words of a name one by one, anything else as it is."""
    if kind != "name":
        return [(kind, canon)]
    given, _, family = canon.partition("|")
    return [("given", w) for w in given.split(" ") if w] + [("family", w) for w in [family] if w]


_FEMALE, _MALE = {n.lower() for n in FEMALE}, {n.lower() for n in MALE}


def gender(given: str) -> str:
    """``f`` or ``m`` of a folded given name if it is common or its ending tells, else ``u``: unknown."""
    if given in _FEMALE or given in _MALE:
        return "f" if given in _FEMALE else "m"
    if script_of(given) in ("latin", "cyrillic") and len(given) > 3:
        if given.endswith(("ia", "na", "la", "ra", "ta", "да", "на", "ия", "ла")):
            return "f"
        if given.endswith(("us", "rt", "ld", "rd", "слав", "мир")):
            return "m"
    return "u"


def script_of(word: str) -> str:
    for c in word:
        if c.isalpha():
            for name, (low, high) in _RANGES.items():
                if low <= c <= high:
                    return name
    return "latin"


_RANGES = {"greek": ("Ͱ", "Ͽ"), "cyrillic": ("Ѐ", "ԯ"), "hebrew": ("֐", "׿"), "arabic": ("؀", "ۿ"), "devanagari": ("ऀ", "ॿ"), "kana": ("぀", "ヿ"), "han": ("一", "鿿"), "hangul": ("가", "힣")}


def surrogate_of(kind: str, canon: str, attempt: int, secret: bytes) -> str:
    """The canonical replacement of an entity, drawn by key; every further attempt draws from a larger pool.

    Given names keep gender and script, family names their script; where no gender is known the surrogate has an ending of neither.
    """
    mac = hmac.new(secret, f"{kind}|{canon}|{attempt}".encode(), hashlib.sha256).digest()
    pick = int.from_bytes(mac, "big")

    def draw(choices):
        nonlocal pick
        pick, at = divmod(pick, len(choices))
        return choices[at]

    if kind in ("given", "family"):
        script = script_of(canon)
        first, second = SCRIPTS[script]
        if script in ("han", "hangul", "kana"):
            return draw(first) + "".join(draw(second) for _ in range((2 if kind == "given" else 1) + attempt))
        syllables = "".join(draw(first) + draw(second) for _ in range((3 if kind == "given" else 2) + attempt))
        if script == "latin" and kind == "family":
            return draw(HEADS) + syllables + draw(TAILS)
        sex = gender(canon) if kind == "given" else "u"
        ends = {"f": {"latin": ["na", "la", "ra"], "cyrillic": ["на", "ла", "ра"]}, "m": {"latin": ["n", "r", "s", "k"], "cyrillic": ["н", "р", "с", "к"]}}.get(sex, {}).get(script, [""])
        return (syllables + draw(ends)).capitalize()
    if kind == "email":
        return f"{draw('bcdfghklmnprst')}{mac[:6 + attempt].hex()}@mail{pick % 97}.example"
    if kind == "address":
        street = draw(HEADS) + "".join(draw("bdfgklmnprstv") + draw("aeiou") for _ in range(2 + attempt)) + draw(TAILS)
        return f"{1 + pick % 1899} {street}"
    digits = iter(str(int.from_bytes(mac, "big")).zfill(78) * (1 + len(canon) // 78))
    if kind == "id_number":
        return "".join(next(digits) if c.isdigit() else c for c in canon)
    keep = 3 if len(canon) > 9 else 1
    return canon[:keep] + "".join(next(digits) for _ in canon[keep:])


_KIND_WORD = re.compile(rf"(?i)\b(?:{'|'.join(sorted(SUFFIX, key=len, reverse=True))})\b\.?")
_LEAD_WORD = re.compile(rf"(?i)\b(?:{'|'.join(sorted(PREFIX, key=len, reverse=True))})\b(?:{B}+(?:de|del|des|du|la|le|les|las|los|da|do|dos)\b)*")
_TAIL_WORD = re.compile(rf"(?i)({'|'.join(sorted(GERMAN, key=len, reverse=True))})(?={B}+\d)")


def written_like(kind: str, piece: str, surrogate: str | dict) -> str:
    """A canonical surrogate in the format, order and letter case of the mention it replaces.

    For a name ``surrogate`` is the replacement of each of its folded words, as ``(part, word)``.
    """
    if kind in ("phone", "id_number"):
        chars = iter(re.sub(r"\W", "", surrogate))
        return "".join((next(chars, c) if c.isalnum() else c) for c in piece) if kind == "id_number" else "".join((next(chars, c) if c.isdigit() else c) for c in piece)
    if kind == "name":
        roles = {}
        for (part, word), put in surrogate.items():
            roles.setdefault(word, (part, put))

        def swap(m):
            word = fold(m.group())
            if word in roles:
                put = roles[word][1]
                return put.upper() if m.group().isupper() and len(m.group()) > 1 else put.lower() if m.group().islower() else put
            # An initial follows the names it stands with.
            return next(iter(surrogate.values()))[0].upper() if len(word) == 1 and word.isascii() else m.group()

        return _NAME_WORD.sub(swap, piece)
    if kind == "email":
        at = re.search(r"\(at\)|\s*\[at\]\s*|@|\s+at\s+", piece, re.I)
        dot = re.search(r"\s*\[dot\]\s*|\s*\(dot\)\s*|\s+dot\s+", piece, re.I)
        out = surrogate.replace("@", at.group() if at else "@")
        if dot:
            head, _, tail = out.rpartition(".")
            out = head + dot.group() + tail
    else:
        house, _, street = surrogate.partition(" ")
        lead, tail, end = _LEAD_WORD.search(piece), _TAIL_WORD.search(piece), _KIND_WORD.search(piece)
        if lead and piece[:1].isdigit():
            out = f"{house} {lead.group()} {street}"
        elif tail and not piece[:1].isdigit():
            out = f"{street}{tail.group().lower()} {house}"
        else:
            out = f"{house} {street} {end.group() if end else 'Street'}"
    return out.upper() if piece.isupper() else out.lower() if piece.islower() else out


_SPANS = "row_id bigint, field_name string, kind string, start_pos int, end_pos int"


def _finder(names: tuple):
    """What makes the finder of these names, once a worker."""
    given, family, *more = names
    tag = hashlib.md5("|".join([*given, "", *family, *(x or "" for x in more)]).encode()).hexdigest()
    return lambda: worker_cache(f"finder|{tag}", lambda: Finder(given, family, *more))


def entities(rows: DataFrame, names: tuple, with_text: bool = False) -> DataFrame:
    """One row per piece of personal information in ``text`` and ``author``.

    ``start_pos`` is 0-based in characters; pieces do not overlap. Null and empty
    fields have none. ``with_text`` adds what was found as ``piece`` and its canonical form as
    ``canon``. Extra columns are ignored; repeated rows report their pieces each.
    """
    ready = _finder(names)

    def run(batches):
        finder = ready()
        for batch in batches:
            out = {"row_id": [], "field_name": [], "kind": [], "start_pos": [], "end_pos": []}
            pieces, canons = [], []
            ids = batch.column("row_id").to_pylist()
            for field, find in (("text", finder.find), ("author", finder.author)):
                for i, value in zip(ids, batch.column(field).to_pylist()):
                    if not value:
                        continue
                    for s, e, kind in find(value):
                        for name, v in zip(out, (i, field, kind, s, e)):
                            out[name].append(v)
                        if with_text:
                            pieces.append(value[s:e])
                            canons.append(canonical(kind, value[s:e], finder.given))
            columns = [pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()))]
            labels = list(out)
            if with_text:
                columns += [pa.array(pieces, pa.string()), pa.array(canons, pa.string())]
                labels += ["piece", "canon"]
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    schema = _SPANS + (", piece string, canon string" if with_text else "")
    return rows.select("row_id", "text", "author").mapInArrow(run, schema)


def surrogates(found: DataFrame, secret: bytes, attempts: int = 40) -> DataFrame:
    """``(kind, canon, attempt, surrogate)``: one replacement per distinct entity, all of them different.

    Names are drawn for word by word (kinds ``given`` and ``family``), so a whole
    name and a part of it stay linked. Entities draw by key. Of those that draw the same, or what is a real entity of the
    table, all but the one with the smallest canonical form draw again, from a larger pool. The
    shuffles hold distinct entities only.
    """

    def split(batches):
        for batch in batches:
            both = [p for k, c in zip(batch.column("kind").to_pylist(), batch.column("canon").to_pylist()) for p in parts_of(k, c)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in both], pa.string()), pa.array([p[1] for p in both], pa.string())], names=["kind", "canon"])

    pending = cut(found.select("kind", "canon").distinct().mapInArrow(split, "kind string, canon string").distinct(), "entities")
    real = pending.select("kind", F.col("canon").alias("drawn"))
    accepted = None
    for attempt in range(attempts):

        def draw(batches, attempt=attempt):
            for batch in batches:
                kinds, canons = batch.column("kind").to_pylist(), batch.column("canon").to_pylist()
                drawn = [surrogate_of(k, c, attempt, secret) for k, c in zip(kinds, canons)]
                same = [canonical(k, s) for k, s in zip(kinds, drawn)]
                yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("canon"), pa.array(drawn, pa.string()), pa.array(same, pa.string())],
                                                 names=["kind", "canon", "surrogate", "drawn"])

        tried = cut(pending.mapInArrow(draw, "kind string, canon string, surrogate string, drawn string"), "drawn")
        first = tried.groupBy("kind", "drawn").agg(F.min("canon").alias("canon"))
        good = first.join(real, ["kind", "drawn"], "left_anti")
        if accepted is not None:
            good = good.join(accepted.select("kind", "drawn"), ["kind", "drawn"], "left_anti")
        won = tried.join(good.select("kind", "canon"), ["kind", "canon"], "left_semi").withColumn("attempt", F.lit(attempt))
        before = accepted
        accepted = cut(won if accepted is None else accepted.unionByName(won), "accepted")
        pending = cut(tried.select("kind", "canon").join(accepted.select("kind", "canon"), ["kind", "canon"], "left_anti"), "pending")
        drop(before, tried)
        if pending.isEmpty():
            break
    else:
        raise RuntimeError("more entities of one format than it can tell apart")
    return accepted.select("kind", "canon", "attempt", "surrogate")


class _Drawn:
    """The worker's surrogates: computed from the key, with the few entities that had to draw again read from a table."""

    def __init__(self, path: str, secret: bytes):
        import pyarrow.dataset as ds
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(path)
        found = ds.dataset(root, filesystem=system, format="parquet").to_table()
        self.again = {(k, c): a for k, c, a in zip(*(found.column(x).to_pylist() for x in ("kind", "canon", "attempt")))}
        self.secret = secret

    def of(self, kind: str, canon: str) -> str:
        return surrogate_of(kind, canon, self.again.get((kind, canon), 0), self.secret)

    def written(self, kind: str, piece: str, canon: str) -> str:
        if kind == "name":
            return written_like(kind, piece, {p: self.of(*p) for p in parts_of(kind, canon)} or {("family", ""): "N"})
        return written_like(kind, piece, self.of(kind, canon))


def replaced(rows: DataFrame, names: tuple, drawn: DataFrame, secret: bytes) -> DataFrame:
    """``text`` and ``author`` of every row with each piece replaced by its surrogate.

    One pass without a shuffle: a surrogate follows from the key, and the entities that
    drew more than once (some n² / 2 out of a pool of millions to billions, by kind) are read by each worker from the
    shared folder. Null stays null, text without pieces unchanged.
    """
    ready = _finder(names)
    path = scratch_path(rows.sparkSession, "drawn-again")
    drawn.filter("attempt > 0").select("kind", "canon", "attempt").write.parquet(path)

    def run(batches):
        finder, put = ready(), worker_cache(f"drawn|{path}", lambda: _Drawn(path, secret))
        for batch in batches:
            columns = [batch.column("row_id")]
            for field, find in (("text", finder.find), ("author", finder.author)):
                out = []
                for value in batch.column(field).to_pylist():
                    for s, e, kind in reversed(find(value) if value else ()):
                        value = value[:s] + put.written(kind, value[s:e], canonical(kind, value[s:e], finder.given)) + value[e:]
                    out.append(value)
                columns.append(pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "text", "author"])

    return rows.select("row_id", "text", "author").mapInArrow(run, "row_id bigint, text string, author string")


def redacted(rows: DataFrame, names: tuple) -> DataFrame:
    """Every row with its pieces replaced by ``[EMAIL]``, ``[PHONE]``, ``[ID_NUMBER]``, ``[ADDRESS]``, ``[NAME]``.

    One pass without a shuffle. Null stays null, text without pieces unchanged.
    """
    ready = _finder(names)

    def run(batches):
        finder = ready()
        for batch in batches:
            columns = [batch.column("row_id")]
            for field, find in (("text", finder.find), ("author", finder.author)):
                out = []
                for value in batch.column(field).to_pylist():
                    for s, e, kind in reversed(find(value) if value else ()):
                        value = f"{value[:s]}[{kind.upper()}]{value[e:]}"
                    out.append(value)
                columns.append(pa.array(out, pa.string()))
            yield pa.RecordBatch.from_arrays(columns, names=["row_id", "text", "author"])

    return rows.select("row_id", "text", "author").mapInArrow(run, "row_id bigint, text string, author string")


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "evidence_sample").select("row_id", "text", "author")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each piece of personal information begins."""
    rows = _rows(spark, sf_dir)
    return entities(rows, learn_names(rows)).select("row_id", "field_name", "kind", F.col("start_pos").cast("bigint").alias("start_pos"))


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row with typed placeholders."""
    rows = _rows(spark, sf_dir)
    return redacted(rows, learn_names(rows))


def p4_surrogates(spark: SparkSession, sf_dir: str, secret: bytes | None = None) -> DataFrame:
    """Every row with type-consistent surrogates, the same one for each mention of an entity.

    Without a ``secret``, that of the setting ``spark.lodestone.secret`` is taken; without
    either, a random one that lasts for this result only.
    """
    kept = spark.conf.get("spark.lodestone.secret", None)
    secret = secret or (kept.encode() if kept else os.urandom(32))
    rows = _rows(spark, sf_dir)
    names = learn_names(rows)
    found = entities(rows, names, with_text=True).select("kind", "canon")
    return replaced(rows, names, surrogates(found, secret), secret)


QUERIES = {"p4_found": p4_found, "p4_redacted": p4_redacted, "p4_surrogates": p4_surrogates}
ORACLES: dict[str, str] = {}
