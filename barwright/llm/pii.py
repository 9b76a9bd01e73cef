"""Surrogates for personal data (operator 5).

Entities are found in whole texts: e-mail addresses, IP addresses of both versions, payment cards, phone
numbers (with separators or a country code, or plain after a word like "call"), social security numbers,
IBANs and names (after a title or a phrase like "my name is", or with a known first name). A part of a
name that was found stands for the same person wherever else it stands alone in the text.

Each is replaced by a keyed surrogate of its own kind: digits by digits in the same layout (a card that
passes the Luhn test gets one that passes, an IBAN check digits that fit), letters by letters of the same
case, first names by names of the same gender (or of none, where nothing tells it) and script, surnames
by made-up ones of the same script; a script without lists here by other letters of its own. Names are
mapped part by part and e-mail domains on their own, so "Mr Weber" and "Anna Weber", or two addresses at
one host, still belong together.

A surrogate depends only on the key, the kind, the normalised value and a try number. Over the whole
corpus, distinct values are given distinct surrogates that are nobody's real value: where a surrogate
is taken or real, the value goes to the next try. Only such exceptions need to be known when texts
are rewritten; they are broadcast while they are at most `BROADCAST_EXCEPTIONS`, and joined to the rows
that hold them beyond that.

Defined results
    null text        stays null, no entity. Empty text stays empty.
    overlaps         the leftmost match, then the kind listed first, wins.
    lone names       replaced where the text holds them as part of a name; not written small.
    collisions       of values that share a surrogate, the least value keeps it.
    repeated rows    the same text for each. An empty table gives no rows.
    other columns    carried by `pseudonymise_rows`; the entity count is added there as `n_entities`
                     (a column of that name is replaced).
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm.common import NARROW, cut, pieces

#: Exceptions sent to every worker at most (about 100 bytes each).
BROADCAST_EXCEPTIONS = 500_000

#: First names by script and gender, and syllables of surnames by script.
FIRST = {
    ("latin", "f"): "Anna Maria Laura Julia Emma Clara Sophie Elena Marta Alice Ines Paula Nora Lucia Eva Hanna Carla Irene Olga Lea".split(),
    ("latin", "m"): "Paul Peter Thomas Martin David Lucas Jan Simon Carlos Pablo Louis Henri Oscar Felix Hugo Anton Marco Victor Adam Karl".split(),
    ("cyrillic", "f"): "Анна Мария Ольга Елена Ирина Нина Вера Юлия Дарья София".split(),
    ("cyrillic", "m"): "Иван Пётр Антон Олег Павел Игорь Борис Юрий Денис Роман".split(),
    ("greek", "f"): "Μαρία Ελένη Άννα Σοφία Ειρήνη Δήμητρα".split(),
    ("greek", "m"): "Γιώργος Νίκος Πέτρος Κώστας Αλέξης Δημήτρης".split(),
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe fi ga go ha ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se so ta te to va ve vo".split(),
    "cyrillic": "ба ва га да ка ла ма на па ра са та во го до ко ло мо но ро со то".split(),
    "greek": "βα γα δα κα λα μα να πα ρα σα τα βο γο δο κο λο μο νο ρο το".split(),
}
#: First names that tell no gender, by script; never searched for.
NEUTRAL = {
    "latin": "Alex Robin Kim Sascha Noa Charlie Dominique Camille Sam Toni Luca Jules Kaya Mika Rene Quinn".split(),
    "cyrillic": "Саша Женя Валя Шура Слава Паша Тоша Рома".split(),
    "greek": "Άλεξ Ντάνι Φώτη Ζωή Χάρι Λίνο".split(),
}
#: Last letters of made-up first names, by script and gender.
ENDINGS = {"latin": {"f": "a", "m": "nrs", "": "ie"}, "cyrillic": {"f": "ая", "m": "нрс", "": "ио"}, "greek": {"f": "αη", "m": "ς", "": "ιο"}}
#: Titles and the gender that they tell.
TITLES = {"mr": "m", "herr": "m", "señor": "m", "sr": "m", "monsieur": "m", "mrs": "f", "ms": "f", "miss": "f", "frau": "f", "señora": "f", "sra": "f", "madame": "f", "mme": "f", "dr": "", "prof": "", "г-н": "m", "г-жа": "f"}
_GENDER = {n.casefold(): (s, g) for (s, g), names in FIRST.items() for n in names}

_EMAIL = re.compile(r"(?<![\w.%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![A-Za-z0-9-])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Layouts of digits; a run must end before letters, digits or further parts of a longer number.
_DIGITS = re.compile(
    r"(?<![\w.+-])(?:"
    r"(?P<ip>(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3})(?!\w|\.\d)"
    r"|(?P<ssn>\d{3}-\d{2}-\d{4})(?![\w-])"
    r"|(?P<card>\d{13,19}|\d{4}(?P<gap>[ -])\d{4}(?P=gap)\d{4}(?P=gap)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?!\w|[.-]\d)"
    r"|(?P<phone>(?:\+\d{1,3}[ .-]?)(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w|[.-]\d)"
    r")"
)
_IPV6 = re.compile(r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
#: A plain number after a word that tells a phone.
_CALL = re.compile(r"(?<!\w)(?i:call(?:ed|ing)?|phoned?|tel|telephone|mobile|cell|fax|dial(?:led)?|rang)(?:[ ](?i:me|us|him|her|them|at|on|is|no|number))*[.:]?[ ](?P<phone>\d{7,12})(?!\w|[.-]\d)")
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
#: Combining marks, which belong to the letters before them.
_MARKS = "".join(x for x in map(chr, range(0x300, 0xFB00)) if unicodedata.category(x) in ("Mn", "Mc"))
_LETTER = rf"(?:[^\W\d_]|[{_MARKS}])"
_CAP = rf"[^\W\d_a-zß-öø-ÿа-яά-ώ]{_LETTER}+(?:-{_LETTER}+)*"
_NAME = re.compile(rf"(?<!\w)(?:(?P<title>(?i:{_TITLE}))\.?\x20(?P<rest>{_CAP}(?:\x20{_CAP})?)|(?i:my name is|name:|signed by|written by|contact:|attn:|sincerely,|regards,)\s(?P<cued>{_CAP}\x20{_CAP})|(?P<first>{'|'.join(sorted({n for v in FIRST.values() for n in v}))})\x20(?P<last>{_CAP}))(?!\w)")
_HINT = re.compile(r"[0-9@]")


_WORD = re.compile(rf"{_LETTER}+(?:-{_LETTER}+)*")


def script(word: str) -> str:
    """The script of the first letter: the first word of its Unicode name."""
    c = ord(word[0])
    if c < 0x250:
        return "latin"
    return unicodedata.name(word[0], "unknown").split(" ")[0].split("-")[0].lower()


def _names(text: str) -> list[tuple[int, int, list[tuple[int, int, str, str]]]]:
    """(start, end, parts) of names."""
    out = []
    for m in _NAME.finditer(text):
        gender = TITLES.get((m["title"] or "").casefold(), "")
        at = m.start("rest") if m["title"] else m.start("first") if m["first"] else m.start("cued")
        names, parts = text[at : m.end()].split(" "), []
        for k, w in enumerate(names):
            known = _GENDER.get(w.casefold())
            kind = f"first:{script(w)}:{known[1] if known else gender}" if known or k < len(names) - 1 else f"last:{script(w)}"
            parts.append((at, at + len(w), kind, ""))
            at += len(w) + 1
        out.append((m.start(), m.end(), parts))
    return out


def _alone(text: str, names: list[tuple[int, int, list]]) -> list[tuple[int, int, list]]:
    """The names with one kind for each word of the text (a gender told anywhere counts everywhere), and
    their parts where they stand alone."""
    kinds: dict[tuple[str, str], str] = {}
    for _, _, parts in names:
        for s, e, kind, _ in parts:
            key = (text[s:e].casefold(), kind.split(":")[0])
            kinds[key] = max(kinds.get(key, ""), kind, key=len)
    out = [(s, e, [(x, y, kinds[text[x:y].casefold(), k.split(":")[0]], "") for x, y, k, _ in parts]) for s, e, parts in names]
    lone = {w: kinds.get((w, "last")) or kinds[w, "first"] for w, _ in kinds}
    for m in _WORD.finditer(text):
        if (kind := lone.get(m[0].casefold())) and not m[0].islower():
            out.append((m.start(), m.end(), [(m.start(), m.end(), kind, "")]))
    return out


def _is_ipv6(value: str) -> bool:
    try:
        ipaddress.IPv6Address(value)
    except ValueError:
        return False
    return sum(c != ":" for c in value) >= 4


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, extra) of entities, left to right without overlaps; for names one entry a part."""
    got: list[tuple[int, int, int, list[tuple[int, int, str, str]]]] = []
    if _HINT.search(text):
        if "@" in text:
            for m in _EMAIL.finditer(text):
                at = text.index("@", m.start()) + 1
                got.append((m.start(), 0, m.end(), [(m.start(), at - 1, "mailbox", text[at : m.end()].casefold()), (at, m.end(), "host", "")]))
        got += [(m.start(), 1, m.end(), [(m.start(), m.end(), m.lastgroup if m.lastgroup != "gap" else "card", "")]) for m in _DIGITS.finditer(text)]
        got += [(m.start(), 2, m.end(), [(m.start(), m.end(), "iban", "")]) for m in _IBAN.finditer(text)]
        got += [(m.start("phone"), 3, m.end(), [(m.start("phone"), m.end(), "phone", "")]) for m in _CALL.finditer(text)]
        if ":" in text:
            got += [(m.start(), 4, m.end(), [(m.start(), m.end(), "ipv6", "")]) for m in _IPV6.finditer(text) if _is_ipv6(m[0])]
    if names := _names(text):
        got += [(s, 5 + (k >= len(names)), e, parts) for k, (s, e, parts) in enumerate(_alone(text, names))]
    out, end = [], 0
    for s, _, e, parts in sorted(got, key=lambda x: x[:3]):
        if s >= end:
            out += parts
            end = e
    return out


def norm(kind: str, value: str, extra: str = "") -> str:
    """What makes two mentions the same: case, gaps and separators don't count."""
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return f"{value.casefold()}@{extra}" if kind == "mailbox" else value.casefold()


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.seed, self.n = key, "\x1f".join(what).encode(), 0
        self.left = 0
        self.value = 0

    def below(self, n: int) -> int:
        if self.left < 1 << 64:
            self.value = int.from_bytes(hashlib.blake2b(self.seed + self.n.to_bytes(4, "big"), key=self.key).digest(), "big")
            self.left = 1 << 512
            self.n += 1
        self.value, out = divmod(self.value, n)
        self.left //= n
        return out


def luhn(digits: str) -> bool:
    total = sum((d if i % 2 == 0 else d * 2 - 9 * (d > 4)) for i, d in enumerate(map(int, reversed(digits))))
    return total % 10 == 0


def _digits(s: _Stream, value: str, keep: int = 0) -> str:
    """Other digits in the same layout; the first `keep` digits and a leading zero stay as they are."""
    out, seen = [], 0
    for c in value:
        if not c.isdigit():
            out.append(c)
            continue
        out.append(c if seen < keep or c == "0" and seen == 0 else str(1 + s.below(9) if seen == 0 else s.below(10)))
        seen += 1
    return "".join(out)


def _letters(s: _Stream, value: str) -> str:
    def one(c: str) -> str:
        if c.isdigit():
            return str(s.below(10))
        if c.isascii() and c.isalpha():
            x = chr(97 + s.below(26))
            return x.upper() if c.isupper() else x
        return c

    return "".join(map(one, value))


def surrogate(key: bytes, kind: str, normal: str, attempt: int) -> str:
    """The normalised surrogate of a normalised value."""
    s = _Stream(key, kind, normal, str(attempt))
    if kind == "mailbox":
        local, _, host = normal.rpartition("@")
        return f"{_letters(s, local)}@{host}"
    if kind == "host":
        labels = normal.split(".")
        return ".".join([_letters(s, x) for x in labels[:-1]] + labels[-1:])
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "card":
        new = _digits(s, normal, keep=1)
        if luhn(normal):
            new = next(new[:-1] + d for d in "0123456789" if luhn(new[:-1] + d))
        return new
    if kind in ("phone", "ssn"):
        return _digits(s, normal, keep=1 if kind == "phone" and len(normal) > 10 else 0)
    if kind == "ipv6":
        return "".join("0123456789abcdef"[s.below(16)] if c in "0123456789abcdef" else c for c in normal)
    if kind == "iban":
        body = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in normal[4:])
        return normal[:2] + iban_check(normal[:2], body) + body
    part, scr, *gender = kind.split(":")
    return "-".join(_name(s, part, scr, gender[0] if gender else "", w, attempt) for w in normal.split("-"))


def iban_check(country: str, body: str) -> str:
    """The two digits that make the account number pass."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in body + country + '00')) % 97:02}"


def _name(s: _Stream, part: str, scr: str, gender: str, normal: str, attempt: int) -> str:
    """Another name: of the lists at the first tries, then a made-up one with the gender's ending."""
    if scr not in SYLLABLES:
        return "".join(_alike(s, c) for c in normal)
    if part == "first" and attempt < 3:
        pool = [n for n in (FIRST[scr, gender] if gender else NEUTRAL[scr]) if n.casefold() != normal]
        return pool[s.below(len(pool))].casefold()
    syl = SYLLABLES[scr]
    made = "".join(syl[s.below(len(syl))] for _ in range(2 + s.below(2) + (part == "last") + attempt // 6))
    if part == "first":
        ends = ENDINGS[scr][gender]
        made = (made if gender == "m" else made[:-1]) + ends[s.below(len(ends))]
    return made


def _alike(s: _Stream, c: str) -> str:
    """Another letter of the same script and class, from the 128 characters around."""
    kind, of = unicodedata.category(c), unicodedata.name(c, "").split(" ")[0].split("-")[0]
    low = ord(c) & ~127
    pool = [x for x in map(chr, range(low, low + 128)) if x != c and unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0].split("-")[0] == of]
    return pool[s.below(len(pool))] if pool else c


def dress(kind: str, original: str, normal: str) -> str:
    """A normalised surrogate in the layout and case of the mention that it replaces."""
    if kind in ("phone", "card", "ssn") or kind == "iban":
        it = iter(normal)
        return "".join(next(it, "") if c.isalnum() else c for c in original)
    if kind == "mailbox":
        normal = normal.rpartition("@")[0]
        if len(normal) == len(original):
            return "".join(n.upper() if o.isupper() else n for o, n in zip(original, normal, strict=True))
        return normal
    if kind.startswith(("first", "last")):
        return normal.upper() if original.isupper() and len(original) > 1 else "-".join(x.capitalize() for x in normal.split("-"))
    return normal


def rewrite(text: str, key: bytes, attempts: dict[tuple[str, str], int], memory: dict | None = None) -> tuple[str, int]:
    """The text with surrogates, and the number of entities replaced (a name's parts count one each)."""
    out, at, n = [], 0, 0
    for s, e, kind, extra in find(text):
        value = text[s:e]
        who = (kind, norm(kind, value, extra))
        new = memory.get(who) if memory is not None else None
        if new is None:
            new = surrogate(key, *who, attempts.get(who, 0))
            if memory is not None:
                if len(memory) > 200_000:
                    memory.clear()
                memory[who] = new
        out += [text[at:s], dress(kind, value, new)]
        at, n = e, n + 1
    return "".join(out) + text[at:], n


def entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct (kind, normal) of the corpus; duplicates go in the map tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = {(k, norm(k, t[s:e], x)) for t in b.column(0).to_pylist() if t for s, e, k, x in find(t)}
            rows = sorted(got)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["kind", "normal"])

    return docs.select(F.col(text_col).alias("text")).mapInArrow(run, "kind string, normal string").distinct()


def _tries(rows: DataFrame, key: bytes, attempt: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            new = [surrogate(key, k, v, attempt) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(new, pa.string())], names=["kind", "normal", "new"])

    return rows.select("kind", "normal").mapInArrow(run, "kind string, normal string, new string")


def assign(found: DataFrame, key: bytes, most_tries: int = 60) -> tuple[DataFrame, DataFrame]:
    """(kind, normal, new, attempt) for every distinct entity, and the exceptions among them
    (attempt above 0). Each round checks that surrogates are unlike all real values, all surrogates
    given before, and each other."""
    pending, done, exceptions, n = found, None, None, found.count()
    for attempt in range(most_tries):
        tried = cut(_tries(pending.coalesce(max(1, -(-n // NARROW))), key, attempt), "pii-tries")
        real = found.select("kind", F.col("normal").alias("new"))
        free = tried.join(real.hint("merge"), ["kind", "new"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "new").hint("merge"), ["kind", "new"], "left_anti")
        good = cut(free.groupBy("kind", "new").agg(F.min("normal").alias("normal")).select("kind", "normal", "new", F.lit(attempt).alias("attempt")), "pii-good", rows=n)
        done = good if done is None else done.unionAll(good)
        if attempt:
            exceptions = good if exceptions is None else exceptions.unionAll(good)
        pending = cut(tried.select("kind", "normal").join(good.select("kind", "normal").hint("merge"), ["kind", "normal"], "left_anti"), "pii-pending", rows=n)
        if pending.isEmpty():
            break
    else:
        raise ValueError("some entities find no free surrogate")
    return done, exceptions if exceptions is not None else done.limit(0)


def pseudonymise_rows(docs: DataFrame, key: bytes, text_col: str = "text", broadcast_exceptions: int = BROADCAST_EXCEPTIONS) -> DataFrame:
    """The rows of docs with their texts rewritten, and n_entities."""
    spark = docs.sparkSession
    found = cut(entities(docs, text_col), "pii-entities")
    _, exceptions = assign(found, key)
    small = exceptions.limit(broadcast_exceptions + 1).count() <= broadcast_exceptions
    cols = [c for c in docs.columns if c.lower() != "n_entities"]
    rows = docs.select(*cols)
    if small:
        known = {(r.kind, r.normal): r.attempt for r in exceptions.collect()}
        shipped = spark.sparkContext.broadcast(known)
    else:
        rows = rows.join(_per_row(docs, exceptions, text_col).withColumnRenamed("_k", "_tk"), F.xxhash64(docs[text_col]) == F.col("_tk"), "left").drop("_tk")
        shipped = None
    at = cols.index(text_col)
    schema = docs.select(*cols).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict = {}
        for b in pieces(batches):
            texts = b.column(at).to_pylist()
            if shipped is not None:
                got = [rewrite(t, key, shipped.value, memory) if t else (t, 0) for t in texts]
            else:
                own = b.column(len(cols)).to_pylist()
                got = [rewrite(t, key, {(x["kind"], x["normal"]): x["attempt"] for x in o or ()}) if t else (t, 0) for t, o in zip(texts, own, strict=True)]
            new = [pa.array([t for t, _ in got], pa.string()) if k == at else b.column(k) for k in range(len(cols))]
            yield pa.RecordBatch.from_arrays([*new, pa.array([n for _, n in got], pa.int64())], names=[*cols, "n_entities"])

    return rows.mapInArrow(run, schema.add("n_entities", "long"))


def _per_row(docs: DataFrame, exceptions: DataFrame, text_col: str) -> DataFrame:
    """For more exceptions than can be broadcast: (hash of the text, those that it holds). A text with
    the same hash would only get exceptions too many, which do nothing to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            got = [(k, kind, norm(kind, t[s:e], x)) for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if t for s, e, kind, x in find(t)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], names=["_k", "kind", "normal"])

    held = docs.select(F.xxhash64(text_col).alias("_k"), F.col(text_col).alias("text")).mapInArrow(run, "_k long, kind string, normal string").distinct()
    held = cut(held.join(exceptions.select("kind", "normal", "attempt").hint("merge"), ["kind", "normal"]), "pii-held")
    return cut(held.groupBy("_k").agg(F.collect_list(F.struct("kind", "normal", "attempt")).alias("_own")), "pii-rows")
