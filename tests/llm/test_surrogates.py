"""Surrogates over a whole table against a plain loop, and persons across documents."""

import re

from larkspur.llm import surrogates

KEY = b"k"
# Each text with its entities in marks, written by hand: {what is found|kind|canonical value}, the last only where it isn't the entity in small letters.
MARKED = [
    "Mrs. {Anna|name:f} {Schmidt|name:surname} met Mr. {Peter|name:m} {Weber|name:surname}. {Schmidt|name:surname} paid.",
    "Yesterday {Anna|name:f} {Schmidt|name:surname} called; Schmidt and {ANNA|name:f} {SCHMIDT|name:surname}, not Annabel Schmidts.",
    "Anna Weber is someone else, as is Weber.",
    "Write to {a.b@mail.example.com|email} or {A.B@mail.example.com|email}, from {10.0.0.7|ip} and {8.8.8.8|ip}",
    "{a.b@mail.example.com|email} again, card {4111 1111 1111 1111|card|4111111111111111}, phone {(017) 555-7713|phone|0175557713}, password={hunter22x|secret}",
    "Госпожа {Анна|name:f} {Иванова|name:surname} и Господин {Пётр|name:m} {Иванов|name:surname}",
    "{Анна|name:f} {Иванова|name:surname} пришла. Κυρία {Μαρία|name:f} {Παππά|name:surname}",
    "{Peter|name:m} {Weber|name:surname} and Mr. {Jean-Pierre|name:m} {O'Neil|name:surname}; {Jean-Pierre|name:m} {O'Neil|name:surname}.",
    "Password: ________ and Mrs. {A|name:f} {Smith|name:surname}",
    "",
    None,
    "Mrs. {Anna|name:f} {Schmidt|name:surname} met Mr. {Peter|name:m} {Weber|name:surname}. {Schmidt|name:surname} paid.",
    # ordinary prose
    "Miss New York won. Miss Universe came second.",
    "I moved to New York last year; New ideas, new friends.",
    "Sr Data Engineer wanted, a Sr. Engineer too.",
    "The Data team. Data is good, an Engineer is better.",
    "Mr. {John|name:m} {Will|name:m} {Smith|name:surname} is here. Will it rain? {John|name:m} knows, {Smith|name:surname} doesn't. {John|name:m} {Will|name:m} {Smith|name:surname}!",
    "Will it rain? John thinks so. John Will Smith will know.",
    "Mr. {Will|name:surname} came. Will he go? Mr. {Will|name:surname} went.",
    "Sir Walter Raleigh and Miss {Clara|name:f} {Oswald|name:surname} of Blackpool.",
    "Sir Walter, Señora {Inés|name:f} {Vidal|name:surname}; walter and walter sang.",
    "Clara Oswald wrote of Miss {Martha|name:f} {Jones|name:surname}, and {Inés|name:f} {Vidal|name:surname} of Vidal.",
    "We saw {Martha|name:f}  {Jones|name:surname} again. {Jones|name:surname} left. Miss {Jones|name:surname}",
    "Miss {Martha|name:f} {Jones|name:surname} is back",
    "Server version {1.2.3.4|ip}; call {+49 30 1234 5678|phone|493012345678} now? No: {+49 30 1234 5678|phone|493012345678}",
]
MARK = re.compile(r"\{([^|}]+)\|([^|}]+)(?:\|([^}]+))?\}")
TEXTS = [t and MARK.sub(r"\1", t) for t in MARKED]


def marked(text):
    """Pieces of a marked text: plain strings, and (mention, kind, canonical value)."""
    out, at = [], 0
    for m in MARK.finditer(text):
        out += [text[at : m.start()], (m[1], m[2], m[3] or (m[1] if m[2] in ("secret", "ip") else m[1].lower()))]
        at = m.end()
    return [*out, text[at:]]


def expected(texts):
    """The marked texts with surrogates, drawn again, entity by entity, until none clash."""
    parts = [t and marked(t) for t in texts]
    found = {p[1:] for t in parts if t for p in t if isinstance(p, tuple)}
    real = {(k.split(":")[0], v) for k, v in found}
    attempt = dict.fromkeys(found, 0)
    while True:
        drawn = {e: surrogates.surrogate(KEY, *e, n) for e, n in attempt.items()}
        taken, again = {}, set()
        for e in sorted(found, key=lambda e: (attempt[e], e)):
            value = (e[0].split(":")[0], drawn[e])
            if value in real or value in taken:
                again.add(e)
            else:
                taken[value] = e
        if not again:
            break
        for e in again:
            attempt[e] += 1
    lay = lambda p: p if isinstance(p, str) else surrogates._laid_out(p[1], p[0], drawn[p[1:]])
    return [t and "".join(map(lay, t)) for t in parts], drawn


def test_whole_table_equals_a_plain_loop(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.text for r in surrogates.pseudonymize(docs, KEY).collect()}
    want, drawn = expected(MARKED)
    assert [got[k] for k in range(len(TEXTS))] == want
    assert len({(k.split(":")[0], v) for (k, _), v in drawn.items()}) == len(drawn)


def test_a_person_is_replaced_alike_in_all_documents(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    got = {r.doc_id: r.text for r in surrogates.pseudonymize(docs, KEY).collect()}
    first, last = re.match(r"Mrs\. (\w+) (\w+) met", got[0]).groups()
    assert got[1] == f"Yesterday {first} {last} called; Schmidt and {first.upper()} {last.upper()}, not Annabel Schmidts."
    assert got[2] == TEXTS[2]  # another person, whom nobody addresses
    assert re.search(rf"{re.match('Госпожа (.+) и', got[5])[1]} пришла", got[6])
    assert re.fullmatch("[А-Яа-яё]+", got[6].split()[0]) and re.fullmatch("[Α-Ωα-ωάς]+", got[6].split()[-1])
    assert not set("Anna Schmidt Peter Weber Jean-Pierre O'Neil".split()) & set(re.findall(r"[\w'-]+", got[0] + got[7]))
    name = re.search(r"Mr\. (\S+) (\S+);", got[7])
    assert got[7].endswith(f" {name[1]} {name[2]}.") and "-" in name[1] and "'" in name[2]


def test_prose_without_persons_comes_back_unchanged(spark):
    prose = [t for t in MARKED if t and "{" not in t]
    assert len(prose) > 5
    docs = spark.createDataFrame(list(enumerate(prose)), "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_entities) for r in surrogates.pseudonymize(docs, KEY).collect()}
    assert got == {k: (t, 0) for k, t in enumerate(prose)}


def test_entities_of_odd_rows(spark):
    mail, long = "write to jo@mail.example.com", "word " * 60_000 + "jo@mail.example.com"
    rows = [(None, mail), (1, mail), (1, mail), (2, long), (3, None), (4, ""), (5, "naïve 日本語🎉 jo@mail.example.com\x00")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as people", "2 as own", "3 as later", "4 as name", "5 as kinds")
    got = surrogates.pseudonymize(docs, KEY).collect()
    new = next(r.text for r in got if r.doc_id is None).split()[-1]
    assert new != "jo@mail.example.com" and new.endswith(".com") and len(got) == len(rows)
    want = [(i, t and t.replace("jo@mail.example.com", new), int(bool(t)), ["email"] if t else []) for i, t in rows]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert surrogates.pseudonymize(docs.where("false"), KEY).count() == 0


def test_names_fit_gender_script_and_case():
    endings = {s.letters: s.endings for s in surrogates._SCRIPTS}
    for script, values in {"": ("anna", "jo", "friederike"), "Ѐ-ӿ": ("анна", "ия"), "Ͱ-Ͽ": ("μαρία",)}.items():
        for value in values:
            for kind, ends in endings[script].items():
                for attempt in range(8):
                    new = surrogates.surrogate(KEY, f"name:{kind}", value, attempt)
                    assert new.endswith(ends) and new == new.lower() and new.isalpha()
                    assert not script or re.fullmatch(f"[{script}]+", new)


def test_a_family_of_names_stays_apart(spark):
    rows = [("name:f", f"name{chr(97 + k % 26)}{chr(97 + k // 26)}") for k in range(600)] + [("name:m", "abc"), ("name:f", "abc"), ("name:f", "ab")]
    drawn = surrogates.assign(spark.createDataFrame(rows, "kind string, value string"), KEY).collect()
    assert len(drawn) == len({r.surrogate for r in drawn}) == len(rows) and not {r.surrogate for r in drawn} & {v for _, v in rows}
