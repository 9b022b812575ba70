"""PII surrogates: keyed replacements of the same kind, format, script and gender.

An entity is a kind and a canonical value (digits of a number, an e-mail address in lower case, one name).
Its surrogate is drawn from a keyed hash of both and the number of the attempt, so the same entity gets
the same surrogate in all documents and forms, and nobody without the key can tell which.  Numbers keep
length, separators and check digits (Luhn, ISO 7064), addresses keep their network's kind.  Names become names:
syllables of the same script, about as many, with case and hyphens as before and an ending that fits the gender.

Found are e-mail addresses, secrets, IBANs, IPv4 addresses, numbers in the forms of US social security, card and
telephone numbers (a version number or an ISBN of such a form counts as well), and persons.  A form of address that
tells the gender gives a person away ("Mrs. Anna Schmidt").  In a text that addresses a person the full name and each
of its words count wherever they stand, but words that the corpus mostly writes in small letters ("will", "new")
only within the full name and behind the form of address.  Names of two or three words, none of them such a word,
make the roster: in all other documents the full name counts, and nothing less.  Forms of address that are
other things too (``_DOUBTFUL``: "Miss New York", "Sr Data Engineer") give no person away if a word of the name is such a
word or one of ``_NO_NAMES``, and make the roster only from two documents on.  Not found are persons whom no
document addresses, single names in other documents, neutral titles ("Dr."), IPv6 addresses, and numbers in other
groupings.

Distinctness is checked, not assumed: the distinct entities of the corpus are grouped by surrogate, and
all but one of those that collide, and any that hit a real entity, try again until none does.  A format
with few values may have no free one, so from attempt NARROW on surrogates are longer (an IP address moves
to a larger block), twice as much with each attempt: the draw ends whatever the corpus holds.
Texts get the surrogates of the first attempt as they are searched; only those that hold one of the few entities beyond it
are looked at again.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass
from itertools import zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._sql import text_of
from ._store import stored

NARROW = 4  # attempts that keep the format's length
_UPPER = "A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ"
_NAME = rf"[{_UPPER}][^\W\d_]*(?:[-'’][^\W\d_]+)*"
# Forms of address by the gender they tell, and those that mean other things too.
_FEMALE = ("Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Señorita", "Sra", "Madame", "Mademoiselle", "Mme", "Mlle", "Госпожа", "Κυρία")
_MALE = ("Mr", "Mister", "Sir", "Herr", "Herrn", "Señor", "Sr", "Monsieur", "Господин", "Κύριος")
_DOUBTFUL = ("Miss", "Madam", "Mister", "Sir", "Sr", "Sra")
# Words that stand behind a doubtful form of address and are no names.
_NO_NAMES = frozenset(
    """account accountant administrator africa america analyst and architect asia associate australia britain business canada chair chairman chairwoman
    chief china consultant coordinator costumer counsel data design designer developer devops director earth editor electrical embedded engineer
    engineering england europe executive finance financial france frontend germany global grand greece hardware human india international ireland italy
    japan judge justice lead london manager marketing mayor mechanical mexico minister network new north officer operations or partner president prince
    principal product professor program programmer project quality research resources russia sales scientist secretary security sergeant software south spain
    specialist speaker staff supreme systems teen technical technician texas the universe usa vice war western world york""".split()
)
# Given names that are words as well, at a sentence's start above all.
_WORD_NAMES = frozenset("april art august bill bob chance chase christian dawn drew faith frank grace grant guy hope iris jack josh joy june lance major mark may miles nick page pat pierce ray rich rob rose skip sue summer violet wade will young".split())
_PATTERNS = {
    "email": r"(?<![\w.%+\-])[\w%+][\w.%+\-]*@[A-Za-z0-9\-]+(?:\.[A-Za-z0-9\-]+)*\.[A-Za-z]{2,}",
    "secret": r"(?i:\b(?:token|password|passwd|pwd|secret|api[_-]?key|access[_-]?key|key)[\"']?\s*[=:]\s*[\"']?)(?P<secret_value>[\w\-/+.]{8,})|\b(?P<secret_id>AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk[-_](?:live|test)[-_][A-Za-z0-9]{8,}|(?=[0-9a-f]*[a-f])(?=[a-f]*\d)[0-9a-f]{32,64}|(?=[0-9A-F]*[A-F])(?=[A-F]*\d)[0-9A-F]{32,64})\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "card": r"(?<!\d)\d(?:[ \-]?\d){12,18}(?!\d)",
    "phone": r"(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)[ .\-]?|\d{2,4}[ .\-])\d{3,4}[ .\-]\d{3,4}(?!\d)|(?<!\w)\+\d{8,15}(?!\d)",
}
_TITLES = "|".join((*_FEMALE, *_MALE))
_PERSON = re.compile(rf"\b(?P<title>{_TITLES})\.?\s+(?P<names>{_NAME}(?:[^\S\n]+{_NAME}){{0,2}})")
_ADDRESS, _BEHIND = re.compile(_TITLES), re.compile(rf"\b(?:{_TITLES})\.?\s+$")
_RUN = re.compile(rf"\b{_NAME}(?:[^\S\n]+{_NAME})+")
_ANY = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _PATTERNS.items()))
_HINT = re.compile(r"@|\d|(?i:token|password|passwd|pwd|secret|key)")
# Letters of a class are replaced within it.
_LETTERS = ("aeiou", "bcdfghjklmnprstvwz", "àáâäèéêëìíîïòóôöùúûü", "ñçß", "аеиоуыэюя", "бвгдзклмнпрстфх", "αεηιου", "βγδζκλμνπρστ")
_CLASS = {c: letters for letters in _LETTERS for c in letters}


@dataclass(frozen=True)
class _Script:
    """What names of a script are made of."""

    letters: str
    onsets: tuple[str, ...]
    vowels: str
    codas: tuple[str, ...]
    endings: dict[str, tuple[str, ...]]


# Sounds and endings of names by script and kind.
_SCRIPTS = (
    _Script("\u0400-\u04ff", tuple("б в г д з к л м н п р с т ф бр др кр ст тр".split()), "аеиоу", ("", "", "л", "н", "р", "с"), {"f": ("а", "ия", "ина", "ела"), "m": ("н", "р", "с", "т", "л", "слав", "мир"), "surname": ("ов", "ин", "ев", "ко", "ский")}),
    _Script("\u0370-\u03ff", tuple("β γ δ ζ θ κ λ μ ν π ρ σ τ φ στ τρ".split()), "αειου", ("", "", "ν", "ρ", "λ"), {"f": ("α", "ια", "ινα", "η"), "m": ("ος", "ης", "ας", "ων"), "surname": ("ης", "ου", "ιδης", "ακης")}),
    _Script("", tuple("b d f g h j k l m n p r s t v w br dr gr kl st tr".split()), "aeiou", ("", "", "l", "n", "r", "s"), {"f": ("a", "ia", "ina", "ela", "etta"), "m": ("n", "r", "s", "l", "rd", "rt", "ric"), "surname": ("er", "en", "el", "ow", "ing", "ard", "son", "mann")}),
)

Entity = tuple[str, str]


@dataclass(frozen=True)
class Person:
    """A person to be found in a text: names with one blank between them, f or m, whether the text itself addresses the person,
    and the names, in small letters, that are words as well."""

    name: str
    gender: str
    own: bool = True
    words: frozenset[str] = frozenset()

    def kinds(self) -> list[tuple[str, str]]:
        """The names with their kinds: the last is the surname."""
        parts = self.name.split()
        return [(p, "name:surname" if k == len(parts) - 1 else f"name:{self.gender}") for k, p in enumerate(parts)]


class _Stream:
    """Keyed choices, the same for the same key, entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int) -> None:
        self.seed, self.block = hashlib.blake2b(f"{kind}\0{value}\0{attempt}".encode(), key=key[:64], digest_size=64).digest(), 0
        self.left = int.from_bytes(self.seed)

    def below(self, n: int) -> int:
        if self.left.bit_length() < 64:
            self.block += 1
            self.left = int.from_bytes(hashlib.blake2b(self.seed + self.block.to_bytes(8), digest_size=64).digest())
        self.left, out = divmod(self.left, n)
        return out

    def digits(self, n: int) -> str:
        return "".join(str(self.below(10)) for _ in range(n))

    def shaped(self, text: str) -> str:
        """Other letters and digits of the same classes and cases; a letter without a class becomes a consonant."""
        out = []
        for c in text:
            low = c.lower()
            letters = "0123456789" if c.isnumeric() else _CLASS.get(low) or _CLASS.get(unicodedata.normalize("NFD", low)[0])
            letters = letters or (_CLASS[_script(low).onsets[0]] if c.isalpha() else c)
            new = letters[self.below(len(letters))] if len(letters) > 1 else c
            out.append(new.upper() if c != low and len(new.upper()) == 1 else new)
        return "".join(out)

    def more(self, value: str, n: int) -> str:
        """``n`` letters of the value's script, in turns a vowel and a consonant."""
        script = _script(value)
        return self.shaped((script.vowels[0] + script.onsets[0]) * (n // 2 + 1))[:n]

    def one_of(self, values: Sequence[str]) -> str:
        return values[self.below(len(values))]

    def name(self, part: str, ending: str, longer: int) -> str:
        """A name of about as many syllables as ``part``, with one of the script's endings of that kind."""
        script, out = _script(part), []
        for _ in range((1 if len(part) < 4 else max(2, round(len(part) / 3))) + longer):
            out += [self.one_of(script.onsets), self.one_of(script.vowels), self.one_of(script.codas)]
        last = self.one_of(script.endings[ending])
        if last[0] not in script.vowels:  # a consonant follows a vowel
            return "".join(out[:-1]) + last
        return "".join(out[:-2] if len(out) > 3 else [out[0]]) + last


def _script(value: str) -> _Script:
    return next(x for x in _SCRIPTS if not x.letters or re.search(f"[{x.letters}]", value))


def _luhn(digits: str) -> bool:
    return sum(d if k % 2 == 0 else d // 5 + 2 * d % 10 for k, d in enumerate(map(int, reversed(digits)))) % 10 == 0


def _iban_check(country: str, rest: str) -> str:
    number = "".join(str(int(c, 36)) for c in rest + country + "00")
    return f"{98 - int(number) % 97:02d}"


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    """Another canonical value of the kind."""
    s, longer = _Stream(key, kind, value, attempt), 1 << attempt - NARROW if attempt >= NARROW else 0
    if kind == "email":
        user, host = value.rsplit("@", 1)
        name, dot, top = host.rpartition(".")
        return f"{s.shaped(user)}{s.more(top, longer)}@{s.shaped(name)}{dot}{top}"
    if kind == "ip":
        a, b, c, d = value.split(".")
        fixed = 1 if a in ("10", "127") else 2 if (a, b) == ("192", "168") or a == "172" and 16 <= int(b) < 32 else 0
        if longer > 1 or longer and not fixed:  # IPv6: unique local, or the block of documentation
            start = ["fd%02x" % s.below(256)] if fixed else ["2001", "db8"]
            return ":".join([*start, *(f"{1 + s.below(0xFFFF):x}" for _ in range(8 - len(start)))])
        kept = ["10"] if longer else [a, b, c, d][:fixed]
        return ".".join(kept + [str(1 + s.below(223 if k == 0 else 254)) for k in range(len(kept), 4)])
    if kind == "iban":
        rest = "".join(str(s.below(10)) if c.isdigit() else chr(65 + s.below(26)) for c in value[4:]) + s.digits(longer)
        return value[:2] + _iban_check(value[:2], rest) + rest
    if kind == "card":
        body = value[0] + s.digits(len(value) - 2 + longer)
        last = next(d for d in "0123456789" if _luhn(body + d))
        return body + (last if _luhn(value) else str((int(last) + 1 + s.below(9)) % 10))
    if kind == "phone":
        code = len(value) - 10 if len(value) > 10 else 0  # the country's code stays
        return value[:code] + s.digits(len(value) - code + longer)
    if kind == "ssn":
        return f"{100 + s.below(566):03d}{1 + s.below(99):02d}{1 + s.below(9999):04d}" + s.digits(longer)
    if kind == "secret":
        digits = "0123456789abcdef" if re.fullmatch("[0-9a-f]+", value) else "0123456789ABCDEF" if re.fullmatch("[0-9A-F]+", value) else None
        pattern = value + ("0" if digits else "a") * longer
        return "".join(digits[s.below(16)] if digits else str(s.below(10)) if c.isnumeric() else chr((65 if c.isupper() else 97) + s.below(26)) if c.isalpha() else c for c in pattern)
    parts = re.split("([-'’])", value)  # of name:surname, name:f, name:m
    if max(map(len, parts)) == 1:  # initials stay initials
        return s.shaped(value) + s.more(value, longer)
    ending, last = kind.rpartition(":")[2], max(k for k, p in enumerate(parts) if len(p) > 1)
    extra = longer.bit_length()
    return "".join(p if k % 2 else s.shaped(p) if len(p) < 2 else s.name(p, ending, extra if k == last else 0) for k, p in enumerate(parts))


def _canonical(kind: str, mention: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", mention)
    return mention.lower() if kind in ("email",) or kind.startswith("name") else mention.replace(" ", "") if kind == "iban" else mention


def _laid_out(kind: str, mention: str, value: str) -> str:
    """A surrogate in the mention's own format."""
    if kind in ("phone", "card", "ssn"):
        fill = iter(value)
        return "".join([*(next(fill) if c.isdigit() else c for c in mention), *fill])
    if kind == "iban":
        fill = iter(value)
        return "".join([*(" " if c == " " else next(fill) for c in mention), *fill])
    if mention.isupper() and len(mention) > 1 and (kind == "email" or kind.startswith("name")):
        return value.upper()
    if kind.startswith("name") and any(len(p) > 1 for p in re.split("[-'’]", mention)):
        old, new = re.split("([-'’])", mention), re.split("([-'’])", value)
        return "".join(n[:1].upper() + n[1:] if m[:1].isupper() else n for m, n in zip_longest(old, new, fillvalue=""))
    if kind == "email" or kind.startswith("name"):
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip_longest(mention, value, fillvalue=""))
    return value


def addressed(text: str) -> set[tuple[str, str, bool]]:
    """Names of one to three words behind a form of address, with one blank between them, the gender it tells, and whether it is a doubtful one."""
    if not _ADDRESS.search(text):
        return set()
    return {(" ".join(m["names"].split()), "f" if m["title"] in _FEMALE else "m", m["title"] in _DOUBTFUL) for m in _PERSON.finditer(text)}


def name_like(text: str) -> set[str]:
    """All that could be a name of two or three words: so many capitalised words in a row."""
    out = set()
    for run in _RUN.finditer(text):
        words = run[0].split()
        out |= {" ".join(words[k : k + n]) for n in (2, 3) for k in range(len(words) - n + 1)}
    return out


def _named(text: str, people: Iterable[Person]) -> Iterator[tuple[int, int, str]]:
    """Begin, end and kind of each name of ``people`` that counts in the text, in order."""
    known: dict[str, list[str]] = {}  # what to look for, and the kinds of its words
    behind: set[str] = set()  # what counts behind a form of address only
    for person in sorted(people, key=lambda p: (not p.own, p.name)):
        kinds = person.kinds()
        word = len(kinds) == 1 and person.name.lower() in person.words
        if word and person.name not in known:
            behind.add(person.name)
        known.setdefault(person.name, [k for _, k in kinds])
        for part, kind in kinds if person.own else ():
            if part.lower() not in person.words:
                known.setdefault(part, [kind])
                behind.discard(part)
    known |= {name.upper(): kinds for name, kinds in known.items() if len(name) > 1 and name.upper() not in known and name not in behind}
    if not known:
        return
    longest_first = sorted(known, key=len, reverse=True)
    blank = r"[^\S\n]+"
    for m in re.finditer(r"(?<!\w)(?:" + "|".join(blank.join(map(re.escape, name.split())) for name in longest_first) + r")(?!\w)", text):
        name = " ".join(m[0].split())
        if name in behind and not _BEHIND.search(text[max(0, m.start() - 20) : m.start()]):
            continue
        for part, kind in zip(re.finditer(r"\S+", m[0]), known[name], strict=True):
            yield m.start() + part.start(), m.start() + part.end(), kind


def own_people(text: str) -> list[Person]:
    """The persons that a text addresses, as far as the text alone and the fixed lists tell."""
    fixed = lambda name: frozenset(name.lower().split()) & (_NO_NAMES | _WORD_NAMES)
    return [Person(name, gender, True, fixed(name)) for name, gender, doubtful in sorted(addressed(text)) if not (doubtful and fixed(name))]


def mentions(text: str, people: Iterable[Person] | None = None) -> list[tuple[int, int, str]]:
    """Begin, end and kind of the entities of a text, in order, not overlapping; of names those of ``people``, or else of own_people.

    Names are ``name:surname``, ``name:f`` or ``name:m``, in capitals too.  A blank to fill in, as ``Password: ________``, has
    nothing to replace and is no entity.
    """
    found = []
    for m in _ANY.finditer(text) if _HINT.search(text) else ():
        kind = m.lastgroup if m.lastgroup in _PATTERNS else next(k for k in _PATTERNS if m[k] is not None)
        if kind == "secret":
            group = "secret_value" if m["secret_value"] is not None else "secret_id"
            if any(map(str.isalnum, m[group])):
                found.append((m.start(group), m.end(group), kind))
        elif kind != "email" or any(map(str.isalnum, m[0].rpartition(".")[0])):
            found.append((m.start(), m.end(), kind))
    taken = iter([*found, (len(text) + 1, len(text) + 1, "")])
    begin, end, _ = next(taken)
    for name in _named(text, own_people(text) if people is None else people):
        while end <= name[0]:
            begin, end, _ = next(taken)
        if name[1] <= begin:
            found.append(name)
    return sorted(found)


def replaced(text: str, surrogate_of: Callable[[Entity], str], people: Iterable[Person] | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds of its mentions."""
    out, at, kinds = [], 0, []
    for begin, end, kind in mentions(text, people):
        mention = text[begin:end]
        out += [text[at:begin], _laid_out(kind, mention, surrogate_of((kind, _canonical(kind, mention))))]
        at = end
        kinds.append(kind)
    return "".join([*out, text[at:]]) if out else text, kinds


def _rows(schema: dict[str, pa.DataType], rows: Iterable[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.values(), strict=True)], names=list(schema))


def _of_rows(find: Callable[[str], Iterable], columns: dict[str, pa.DataType]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What ``find`` gives for each text, sorted, with the text's doc_id and hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text")), strict=True)
            found = ((d, h, *x) for d, h, t in rows for x in sorted(find(t)))
            yield _rows({"doc_id": pa.int64(), "text_hash": pa.int64()} | columns, found)

    return run


def _people(column: pa.Array) -> list[list[Person]]:
    return [[Person(x["name"], x["gender"], x["own"], frozenset(x["words"])) for x in r or ()] for r in column.to_pylist()]


_REPLACED = "doc_id long, text_hash long, text string, n_entities long, kinds array<string>, entities array<struct<kind:string,value:string>>"


def _replace(key: bytes) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts with surrogates, of the attempts that ``later`` names and else the first, and the entities that they had."""
    entity = pa.struct([("kind", pa.string()), ("value", pa.string())])
    schema = {"doc_id": pa.int64(), "text_hash": pa.int64(), "text": pa.string(), "n_entities": pa.int64(), "kinds": pa.list_(pa.string()), "entities": pa.list_(entity)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = (batch.column(c).to_pylist() for c in ("doc_id", "text_hash", "text", "none", "later"))
            for doc_id, text_hash, text, none, later, people in zip(*columns, _people(batch.column("people")), strict=True):
                attempts = {(x["kind"], x["value"]): x["attempt"] for x in later or ()}
                seen: dict[Entity, str] = {}

                def of(e: Entity) -> str:
                    if e not in seen:  # noqa: B023
                        seen[e] = surrogate(key, *e, attempts.get(e, 0))  # noqa: B023
                    return seen[e]  # noqa: B023

                new, found = replaced(text, of, people)
                out.append((doc_id, text_hash, None if none else new, len(found), sorted(set(found)), [{"kind": k, "value": v} for k, v in seen]))
            yield _rows(schema, out)

    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate) of distinct ``entities`` (kind, value), no two with one surrogate, none with a real one."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([surrogate(key, *r) for r in rows], pa.string())], names=[*batch.schema.names, "surrogate"])

    schema = "kind string, value string, attempt int, surrogate string"
    family = F.split("kind", ":")[0]
    real = entities.select(family.alias("family"), F.col("value").alias("surrogate")).distinct()
    drawn = stored(entities.select("kind", "value", F.lit(0).alias("attempt")).mapInArrow(draw, schema), "surrogates")
    while True:
        marked = drawn.withColumn("family", family)
        first = marked.groupBy("family", "surrogate").agg(F.min(F.struct("attempt", "kind", "value")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
        clash = marked.join(first, ["family", "surrogate"]).where(F.struct("attempt", "kind", "value") != F.col("first")).select("kind", "value", "attempt")
        again = stored(clash.unionByName(marked.join(real, ["family", "surrogate"], "left_semi").select("kind", "value", "attempt")).distinct(), "clashes")
        if again.isEmpty():
            return drawn
        redrawn = again.withColumn("attempt", F.col("attempt") + 1).mapInArrow(draw, schema)
        drawn = stored(drawn.join(again.select("kind", "value"), ["kind", "value"], "left_anti").unionByName(redrawn), "surrogates")


def _joined(rows: DataFrame, found: DataFrame, value: str | None, how: str = "left") -> DataFrame:
    """``rows`` (doc_id, text_hash and more) joined to ``found``, one row a document, for its column ``value``."""
    found = found.select(F.col("doc_id").alias("of_id"), F.col("text_hash").alias("of_hash"), *([value] if value else []))
    same = F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_hash") == F.col("of_hash"))
    return rows.join(found, same, how).drop("of_id", "of_hash")


_LATER = "array<struct<kind:string,value:string,attempt:int>>"
_PEOPLE = "array<struct<name:string,gender:string,own:boolean,words:array<string>>>"
_BLANK = "\\s+"


def _words_among(rows: DataFrame, names: DataFrame) -> DataFrame:
    """(word) of the words of ``names`` (name), in small letters, of which the texts write a quarter or more in small letters, and of the fixed lists."""
    parts = names.select(F.explode(F.split(F.lower("name"), _BLANK)).alias("word")).distinct()
    seen = rows.select(F.explode(F.split("text", "[^\\p{L}]+")).alias("w")).groupBy("w").count()
    seen = seen.groupBy(F.lower("w").alias("word")).agg(F.sum("count").alias("n"), F.sum(F.when(F.col("w") == F.lower("w"), F.col("count")).otherwise(0)).alias("small"))
    # a name with a hyphen or an apostrophe is no word of a text, so it is none of these
    often = parts.join(seen, "word").where(4 * F.col("small") >= F.col("n")).select("word")
    return often.unionByName(parts.where(F.col("word").isin(*sorted(_NO_NAMES | _WORD_NAMES)))).distinct()


def known_names(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, text_hash, text) with ``people``: whom to look for in each text; see the module's text.

    A name that is addressed as both takes the first gender in order.  A corpus that addresses nobody is read once.
    """
    schema = "doc_id long, text_hash long, name string, gender string, doubtful boolean"
    called = rows.mapInArrow(_of_rows(addressed, {"name": pa.string(), "gender": pa.string(), "doubtful": pa.bool_()}), schema)
    called = stored(called.groupBy("doc_id", "text_hash", "name").agg(F.min("gender").alias("gender"), F.min("doubtful").alias("doubtful")), "addressed")
    if called.isEmpty():
        return rows.withColumn("people", F.lit(None).cast(_PEOPLE))
    names = called.groupBy("name").agg(F.min("gender").alias("gender"), F.min("doubtful").alias("doubtful"), F.count("*").alias("docs"))
    parts = names.select("name", F.explode(F.split("name", _BLANK)).alias("part")).select("name", F.lower("part").alias("word"))
    words = parts.join(_words_among(rows, names), "word").groupBy("name").agg(F.sort_array(F.collect_set("word")).alias("words"))
    names = names.join(words, "name", "left").withColumn("words", F.coalesce("words", F.array().cast("array<string>")))
    plain = F.size("words") == 0
    names = stored(names, "names")
    known = names.where(plain & (F.size(F.split("name", _BLANK)) > 1) & (~F.col("doubtful") | (F.col("docs") > 1)))
    own = called.select("doc_id", "text_hash", "name", F.col("doubtful").alias("here")).join(names, "name").where(plain | ~F.col("here"))
    own = own.withColumn("own", F.lit(True)).select("doc_id", "text_hash", "name", "gender", "own", "words")
    # names spread by their text: a name that many documents hold is one row of names, and they are split in the join
    likely = rows.mapInArrow(_of_rows(lambda t: ((n,) for n in name_like(t)), {"name": pa.string()}), "doc_id long, text_hash long, name string")
    others = likely.join(known, "name").withColumn("own", F.lit(False)).select(own.columns)
    both = own.unionByName(others).groupBy("doc_id", "text_hash", "name", "gender", "words").agg(F.max("own").alias("own"))
    by_doc = both.groupBy("doc_id", "text_hash").agg(F.sort_array(F.collect_list(F.struct("name", "gender", "own", "words"))).alias("people"))
    return stored(_joined(rows, by_doc, "people"), "named")


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text with surrogates, n_entities (mentions replaced) and kinds of each row of ``docs``.

    A null text stays null and an empty one empty, with no entities.  Repeated rows get equal results, and a null
    doc_id is an id like others.  Ordinary prose stays as it is: see the module's text for what counts as a name where.
    Very long texts are searched whole.  Other columns are left out, whatever their names.
    """
    if not key:
        raise ValueError("surrogates need a key")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("text_hash"), text_of().alias("text"), F.col("text").isNull().alias("none"))
    rows = known_names(rows)
    rows = rows.select("doc_id", "text_hash", "text", "none", "people", F.lit(None).cast(_LATER).alias("later"))
    first = stored(rows.mapInArrow(_replace(key), _REPLACED), "replaced")
    seen = first.select("doc_id", "text_hash", F.explode("entities").alias("e")).select("doc_id", "text_hash", "e.*")
    later = stored(assign(seen.select("kind", "value").distinct(), key).where("attempt > 0"), "later")
    out = ("doc_id", "text", "n_entities", "kinds")
    if later.isEmpty():
        return first.select(*out)
    # only the documents that hold an entity beyond the first attempt are looked at again
    by_doc = seen.join(later, ["kind", "value"]).groupBy("doc_id", "text_hash")
    by_doc = stored(by_doc.agg(F.collect_set(F.struct("kind", "value", "attempt")).alias("later")), "again")
    again = _joined(rows.drop("later"), by_doc, "later", "inner").mapInArrow(_replace(key), _REPLACED)
    return _joined(first, by_doc, None, "left_anti").select(*out).unionByName(again.select(*out))
