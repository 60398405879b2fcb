"""PII surrogates: detected entities get keyed replacements of their own type and form.

Detection reads whole texts: e-mail and IPv4 addresses, phone, card, account and
social security numbers, access keys, assigned secrets, and persons after a title.
A person's name is replaced word by word - given names and the family name apart - also
where the name or the family name stands without title later in the text, so that all
mentions stay one person.

Replacement: a surrogate is drawn from HMAC-SHA256 of (type, value, attempt) under a
secret key.  It keeps the value's form: letters stay letters of their case, digits
digits, separators where they were; card and account numbers get right check digits,
octets stay in range and private networks private; names keep gender (by the title),
script and capitals.  Equal values get equal surrogates in all documents: surrogates are drawn for a
normal form (a card's digits, an address in lower case, an account without blanks, a phone number's country and
digits) and written the way each value is.

Collisions: the distinct values of the corpus are one table.  A surrogate that is an
original value of its type, or that another value got, is drawn again with the next
attempt; of several values with one surrogate the smallest keeps it.  Rounds go on until
none is left (from attempt ``WIDEN`` on surrogates grow longer, so that small forms
suffice).  So different values stay different and no surrogate is anyone's real value.

Defined cases: null text stays null; texts without entities are unchanged; rows that
repeat id and text are changed alike; overlapping finds go to the first in the order of
types; other columns, whatever their names, are passed on.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from numerale.llm.common import free_name, schema_of, small_batches, stored, texts_of, whole_row

WIDEN = 12

# Titles and the gender they state.
TITLES = {
    "f": "Mrs Ms Miss Frau Señora Doña Madame Mme Госпожа Κυρία",
    "m": "Mr Herr Señor Don Monsieur Господин Κύριος",
    "n": "Dr Prof",
}
GENDER_OF = {t: g for g, titles in TITLES.items() for t in titles.split()}
NAME = r"[A-ZÀ-ÖØ-ÞА-ЯΑ-Ω][^\W\d_]+"
PERSON = re.compile(rf"({'|'.join(GENDER_OF)})\.? ({NAME}(?:[ -]{NAME}){{0,2}})")
NUMBERS = re.compile(
    r"(?P<email>[A-Za-z0-9][\w.+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"
    r"|(?P<key>\b(?:AKIA|ASIA)[A-Z0-9]{16}\b)"
    r"|\b(?i:password|passwd|secret|api[_-]?key|token)[ \t]*[=:][ \t]*[\"']?(?P<secret>[A-Za-z0-9+/_-]{8,})"
    r"|(?P<account>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)"
    r"|(?P<address>(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.]*\d))"
    r"|(?P<card>(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-]))"
    r"|(?P<social>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]?\d{4}(?![\w-]))"
    r"|(?P<international>(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}(?![\w-]))"
)
HINT = re.compile(r"[@\d=:]")  # every type of number or secret holds one of these


def luhn(digits: str) -> int:
    """The check digit to put after ``digits``."""
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (2 if k % 2 == 0 else 1)
        total += n - 9 if n > 9 else n
    return -total % 10


def account_check(country: str, rest: str) -> int:
    """The two check digits of an account number (mod 97)."""
    return 98 - int("".join(str(int(c, 36)) for c in f"{rest}{country}00")) % 97


def valid(kind: str, value: str) -> bool:
    if kind == "address":
        return all(int(x) < 256 for x in value.split("."))
    if kind == "account":
        bare = value.replace(" ", "")
        return 15 <= len(bare) <= 34 and account_check(bare[:2], bare[4:]) == int(bare[2:4])
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        return luhn(digits[:-1]) == int(digits[-1]) or (len(digits) == 16 and digits[0] in "3456")
    return True


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, value) of what is found, in order, without overlaps; positions in characters."""
    found: list[tuple[int, int, str, str]] = []
    if HINT.search(text):
        for m in NUMBERS.finditer(text):
            kind = m.lastgroup
            value = m[kind]
            if kind == "account" and not valid(kind, value):
                continue
            if valid(kind, value):
                found.append((m.start(kind), m.end(kind), "phone" if kind == "international" else kind, value))
    people = [m for m in PERSON.finditer(text) if not text[m.start() - 1 : m.start()].isalnum()]
    if people:
        taken = [(a, b) for a, b, _, _ in found]
        parts: dict[str, str] = {}
        for m in people:
            gender = GENDER_OF[m[1]]
            words = re.split(r"[ -]", m[2])
            for w in words[:-1]:
                parts.setdefault(w, f"given-{gender}")
            parts.setdefault(words[-1], "family")
        names = "|".join(sorted(map(re.escape, parts), key=len, reverse=True))
        for m in re.finditer(rf"\b(?:{names})\b", text):
            if not any(a < m.end() and m.start() < b for a, b in taken):
                found.append((m.start(), m.end(), parts[m[0]], m[0]))
    return sorted(found)


class Draw:
    """Keyed numbers for one (type, value, attempt)."""

    def __init__(self, key: bytes, *parts: str):
        self.seed, self.n, self.left = hmac.new(key, "\x1f".join(parts).encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        word, self.left = self.left[:4], self.left[4:]
        return int.from_bytes(word, "big") % n

    def one(self, choices: str) -> str:
        return choices[self.below(len(choices))]

    def like(self, value: str) -> str:
        """Letters for letters of their case, digits for digits; the rest stays."""
        return "".join(
            self.one("0123456789") if c.isdigit() else self.one("abcdefghijklmnopqrstuvwxyz") if c.islower() else self.one("ABCDEFGHIJKLMNOPQRSTUVWXYZ") if c.isupper() else c
            for c in value
        )


#: Syllables by script: consonants, vowels, endings of female, male and other names.
SOUNDS = {
    "latin": ("bcdfghklmnprstvz", "aeiou", "a", "nrsto", "e"),
    "cyrillic": ("бвгдзклмнпрстф", "аеиоу", "а", "нрвл", "е"),
    "greek": ("βγδζθκλμνπρστφ", "αεηιο", "α", "ς", "ε"),
}


def script_of(word: str) -> str:
    code = ord(word[0])
    return "cyrillic" if 0x400 <= code < 0x530 else "greek" if 0x370 <= code < 0x400 else "latin"


def person_name(draw: Draw, kind: str, value: str, extra: int) -> str:
    consonants, vowels, female, male, other = SOUNDS[script_of(value)]
    syllables = "".join(draw.one(consonants) + draw.one(vowels) for _ in range(2 + draw.below(2) + extra))
    if kind != "family":
        ending = {"given-f": female, "given-m": male}.get(kind, other)
        syllables = syllables[:-1] + draw.one(ending) if kind == "given-f" else syllables + draw.one(ending)
    else:
        syllables += draw.one(consonants)
    if script_of(value) == "greek" and syllables.endswith("σ"):
        syllables = syllables[:-1] + "ς"
    return syllables.upper() if value.isupper() and len(value) > 1 else syllables.capitalize()


def surrogate(key: bytes, kind: str, value: str, attempt: int) -> str:
    draw = Draw(key, kind, value, str(attempt))
    extra = max(0, attempt - WIDEN + 1)
    if kind.startswith("given") or kind == "family":
        return person_name(draw, kind, value, extra)
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        names = domain.split(".")
        host = Draw(key, "domain", domain.lower()).like(".".join(names[:-1]))
        return f"{draw.like(local)}{draw.like('a' * extra)}@{host}.{names[-1]}"
    if kind == "key":
        return value[:4] + "".join(draw.one("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(len(value) - 4 + extra))
    if kind == "secret":
        if re.fullmatch("[0-9a-f]+", value):
            return "".join(draw.one("0123456789abcdef") for _ in range(len(value) + extra))
        return draw.like(value) + draw.like("a" * extra)
    if kind == "address":
        octets = value.split(".")
        kept = 1 if octets[0] == "10" else 2 if octets[:2] == ["192", "168"] or (octets[0] == "172" and 16 <= int(octets[1]) < 32) else 0
        first = [o for o in octets[:kept]] or [str(1 + draw.below(9)) if draw.below(2) else str(11 + draw.below(100))]
        rest = [str(1 + draw.below(254)) for _ in range(4 - len(first))]
        return ".".join(first + rest) + (f":{1 + draw.below(65535)}" if extra else "")
    if kind == "card":
        digits = re.sub(r"\D", "", value)
        made = digits[0] + draw.like(digits[1:-1])
        made = iter(made + str(luhn(made)))
        return "".join(next(made) if c.isdigit() else c for c in value) + draw.like("0" * extra)
    if kind == "account":
        bare = value.replace(" ", "")
        rest = draw.like(bare[4:]) + draw.like("0" * extra)
        made = iter(f"{bare[:2]}{account_check(bare[:2], rest):02d}{rest}")
        return "".join(c if c == " " else next(made) for c in value) + "".join(made)
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?!\d)", value)
        kept = country[0] if country else ""
        return kept + draw.like(value[len(kept) :]) + draw.like("0" * extra)
    return draw.like(value) + draw.like("0" * extra)


def normal_form(kind: str, value: str) -> str:
    """What a value is whatever way it is written: separators and the case of addresses do not count."""
    if kind == "email":
        return value.lower()
    if kind == "card":
        return re.sub(r"\D", "", value)
    if kind == "account":
        return value.replace(" ", "")
    if kind == "phone":
        country = re.match(r"\+\d{1,3}(?!\d)", value)
        kept = country[0] if country else ""
        return f"{kept} " * bool(kept) + re.sub(r"\D", "", value[len(kept) :])
    return value


def written_like(kind: str, value: str, made: str) -> str:
    """A surrogate of a normal form, written the way ``value`` is."""
    if kind == "email":
        return "".join(c.upper() if value[k : k + 1].isupper() else c for k, c in enumerate(made))
    if kind not in ("card", "account", "phone"):
        return made
    left = [c for c in made if c.isalnum()]
    out = [left.pop(0) if c.isalnum() and left else c for c in value]
    return "".join(out + left)


SPANS = "id long, mark long, start int, stop int, kind string, value string"


def spans(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """A row for every entity found; mark tells texts of an id apart."""
    out = schema_of(SPANS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2))):
                rows += [(key, mark, *e) for e in entities(text.decode("utf-8", "replace"))]
            columns = list(zip(*rows)) or [()] * len(out)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("mark"), text_col)
    return rows.mapInArrow(run, SPANS).distinct()


def surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) for distinct (kind, value): distinct surrogates, none of them a value of its kind.

    Surrogates are drawn for normal forms, so that a value keeps its surrogate in every way of writing it.
    """

    @F.arrow_udf("string")
    def normal(kind: pa.Array, value: pa.Array) -> pa.Array:
        return pa.array(list(map(normal_form, kind.to_pylist(), value.to_pylist())), pa.string())

    @F.arrow_udf("string")
    def written(kind: pa.Array, value: pa.Array, made: pa.Array) -> pa.Array:
        return pa.array(list(map(written_like, kind.to_pylist(), value.to_pylist(), made.to_pylist())), pa.string())

    forms = stored(values.select("kind", "value", normal("kind", "value").alias("form")), "pii-forms")
    made = drawn_surrogates(forms.select("kind", F.col("form").alias("value")).distinct(), key)
    made = made.select("kind", F.col("value").alias("form"), F.col("surrogate").alias("made"))
    return forms.join(made, ["kind", "form"]).select("kind", "value", written("kind", "value", "made").alias("surrogate"))


def drawn_surrogates(values: DataFrame, key: bytes) -> DataFrame:
    """``surrogates`` of distinct normal forms."""

    @F.arrow_udf("string")
    def draw(kind: pa.Array, value: pa.Array, attempt: pa.Array) -> pa.Array:
        rows = zip(kind.to_pylist(), value.to_pylist(), attempt.to_pylist())
        return pa.array([surrogate(key, k, v, n) for k, v, n in rows], pa.string())

    group = F.when(F.col("kind").startswith("given"), "given").otherwise(F.col("kind"))
    values = stored(values.withColumn("type", group), "pii-values")
    taken = values.select("type", F.col("value").alias("surrogate"))
    pending, done = values.withColumn("attempt", F.lit(0)), None
    while True:
        drawn = stored(pending.withColumn("surrogate", draw("kind", "value", "attempt")), "pii-drawn")
        first = drawn.groupBy("type", "surrogate").agg(F.min(F.struct("value", "kind")).alias("first"))
        free = first.join(taken, ["type", "surrogate"], "left_anti")
        tried = drawn.join(free, ["type", "surrogate"], "left")
        wins = F.col("first").isNotNull() & (F.struct("value", "kind") == F.col("first"))
        tried = stored(tried.withColumn("wins", F.coalesce(wins, F.lit(False))), "pii-tried")
        won = tried.where("wins").select("kind", "value", "type", "surrogate")
        done = won if done is None else done.unionByName(won)
        lost = tried.where("not wins")
        if lost.isEmpty():
            return done.select("kind", "value", "surrogate")
        taken = taken.unionByName(won.select("type", "surrogate"))
        pending = lost.select("kind", "value", "type", (F.col("attempt") + 1).alias("attempt"))


def pseudonymized(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with entities replaced, and the columns n_replaced and replaced (start, stop, kind, surrogate;
    positions in the old text; with an underscore more where there is a column of that name)."""
    small_batches(docs.sparkSession)
    found = stored(spans(docs, id_col, text_col), "pii-spans")
    made = stored(surrogates(found.select("kind", "value").distinct(), key), "pii-surrogates")
    pairs = found.join(made, ["kind", "value"])
    each = F.sort_array(F.collect_list(F.struct("start", "stop", "kind", "surrogate"))).alias("spans")
    per_doc = pairs.groupBy("id", "mark").agg(each)
    rows = docs.select(whole_row(docs).alias("doc"))
    text = F.col("doc")[text_col]
    same = F.col("doc")[id_col].cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(text) == F.col("mark"))
    out = rows.join(per_doc, same, "left")

    def piece(s, i):
        before = F.when(i > 0, F.get("spans", i - 1)["stop"]).otherwise(0)
        return F.concat(F.substr(text, before + 1, s["start"] - before), s["surrogate"])

    tail = F.substr(text, F.element_at("spans", -1)["stop"] + 1)
    new = F.when(F.col("spans").isNull(), text).otherwise(F.concat(F.array_join(F.transform("spans", piece), ""), tail))
    columns = [(new if c == text_col else F.col("doc")[c]).alias(c) for c in docs.columns]
    n = F.coalesce(F.size("spans"), F.lit(0))
    counted = F.when(n > 0, n).otherwise(0).alias(free_name("n_replaced", docs.columns))
    return out.select(*columns, counted, F.coalesce("spans", F.array()).alias(free_name("replaced", docs.columns)))
