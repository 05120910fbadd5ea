"""Personal data and secrets, replaced by keyed surrogates.

A surrogate has the type and the format of what it replaces: digits stay digits, letters keep their
case, separators stay; card numbers that satisfy the Luhn sum satisfy it again; names keep their
gender, script and capitals. It is a keyed function of the entity's normal form, so that one entity
has one surrogate in all documents and spellings (coreference), and nothing of it can be computed
without the key.

Distinct entities keep distinct surrogates. Formats of characters are permuted within themselves (a
keyed Feistel network over the mixed-radix number that the characters spell), which is one to one.
Names get syllables that spell a keyed permutation of theirs, which is one to one as well. A check
over the distinct entities of the corpus finds surrogates that agree across formats of a type; those
are made again until none is left.

Names are detected behind a title, and then wherever their parts stand alone in the same text. A
given name is one entity whichever title comes before it (or none): its gender is the one that most
titles of the corpus give it, or, if they say nothing, the one that its form suggests.

Null texts stay null, empty texts empty; a text without entities is returned as it is. Texts are
searched whole. Repeated rows are replaced alike; an empty table gives no rows. Columns other than
the text keep their values, but for n_entities and entity_kinds, which give way to those made here.
"""

import bisect
import hashlib
import hmac
import math
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, map_texts, slices, small_batches, table, written

#: The query's key; a deployment passes its own secret.
KEY = b"spindrift demonstration key"

#: Titles by the gender that they tell (m, f, or none).
TITLES = {"Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Dr": "", "Prof": "", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f", "Monsieur": "m", "Madame": "f", "Mme": "f", "Mlle": "f", "Г-н": "m", "Г-жа": "f", "Господин": "m", "Госпожа": "f", "Κύριος": "m", "Κυρία": "f"}
#: Given names by script and gender.
GIVEN = {
    ("latin", "m"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Nico Oscar Paul Ralf Simon Tomas Victor".split(),
    ("latin", "f"): "Alma Berta Clara Diana Elena Frida Greta Helena Irma Julia Klara Laura Maria Nora Olga Paula Rita Sara Tina Vera".split(),
    ("cyrillic", "m"): "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим Олег Павел".split(),
    ("cyrillic", "f"): "Алла Вера Галина Дарья Елена Жанна Инна Ксения Лидия Мария Нина Ольга".split(),
    ("greek", "m"): "Ανδρέας Βασίλης Γιώργος Δημήτρης Ηλίας Θωμάς Κώστας Λεωνίδας Μάριος Νίκος".split(),
    ("greek", "f"): "Άννα Βασιλική Γεωργία Δήμητρα Ελένη Ζωή Ηλέκτρα Θάλεια Κατερίνα Μαρία".split(),
}
#: Consonants, vowels and endings of drawn surnames by script.
SYLLABLES = {"latin": ("bdfgklmnprstvz", "aeiou", ["n", "r", "s", "l"]), "cyrillic": ("бвгдзклмнпрст", "аеиоу", ["нов", "рин", "сов", "лин"]), "greek": ("βγδκλμνπρστ", "αεηιο", ["ς", "κης", "νος", "ρας"])}

_NAME = r"[^\W\d_a-zа-яα-ω][^\W\d_]+(?:-[^\W\d_]+)?"
#: What each type looks like; the earlier type wins where two begin alike.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:ghp|gho|ghs)_[A-Za-z0-9]{36}|(?<![A-Za-z0-9])sk-[A-Za-z0-9]{20,}",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)\s*[=:]\s*[\"']?)(?P<secret>[^\s\"',;<>]{6,})",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d|\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w(])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-. ]\d{4}(?!\w)",
    "card": r"(?<![\w-])[3-6]\d{3}([ -]?)\d{4}\1\d{4}\1\d{1,7}(?![\w-])",
    "name": rf"(?<!\w)(?:{'|'.join(sorted(TITLES, key=len, reverse=True))})\.? {_NAME}(?: {_NAME})?",
}
_ANY = re.compile("|".join(f"(?P<t_{kind}>{p.replace(chr(92) + '1', '(?P=gap)').replace('([ -]?)', '(?P<gap>[ -]?)')})" for kind, p in PATTERNS.items()))
_DIGIT = re.compile(r"\d")
_ASSIGNED = ("password", "passwd", "pwd", "token", "secret", "key")
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "sk-")
#: Entities whose draw or gender isn't the one that they have by themselves, that are broadcast at
#: most (some 300 bytes each in a worker); beyond, texts meet theirs in a join.
BROADCAST_ENTITIES = 1 << 17


def hinted(text: str) -> bool:
    """Whether a text may hold an entity; if not, the search is left out."""
    if "@" in text or _DIGIT.search(text) or any(map(text.__contains__, _KEY_STARTS)) or any(map(text.__contains__, TITLES)):
        return True
    if "=" not in text and ":" not in text:
        return False
    folded = text.casefold()
    return any(map(folded.__contains__, _ASSIGNED))


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _alphabet(c: str, hexadecimal: bool = False) -> str:
    if hexadecimal and c in "0123456789abcdef":
        return "0123456789abcdef"
    return _DIGITS if c in _DIGITS else _LOWER if c in _LOWER else _UPPER if c in _UPPER else ""


def permuted(value: int, size: int, key: bytes) -> int:
    """A keyed permutation of 0 ... size - 1: a Feistel network over the next even number of bits,
    walked on until it falls in the range."""
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    low = (1 << half) - 1
    while True:
        left, right = value >> half, value & low
        for turn in range(8):
            drawn = hmac.new(key, b"%d:%d:%x" % (turn, size, right), hashlib.sha256).digest()
            left, right = right, left ^ int.from_bytes(_stretched(drawn, half), "big") & low
        value = left << half | right
        if value < size:
            return value


def _stretched(drawn: bytes, bits: int) -> bytes:
    out = drawn
    while 8 * len(out) < bits:
        out += hashlib.sha256(out).digest()
    return out


def same_format(text: str, key: bytes, hexadecimal: bool = False) -> str:
    """text with each letter and digit replaced within its class; one to one for a format."""
    classes = [_alphabet(c, hexadecimal) for c in text]
    value, size = 0, 1
    for c, alphabet in zip(text, classes, strict=True):
        if alphabet:
            value, size = value * len(alphabet) + alphabet.index(c), size * len(alphabet)
    out, value = [], permuted(value, size, key)
    for c, alphabet in zip(reversed(text), reversed(classes), strict=True):
        if alphabet:
            value, digit = divmod(value, len(alphabet))
            c = alphabet[digit]
        out.append(c)
    return "".join(reversed(out))


def luhn_digit(payload: str) -> str:
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(payload)))
    return str(-total % 10)


def script_of(word: str) -> str:
    c = ord(word[0])
    return "greek" if 0x370 <= c < 0x400 else "cyrillic" if 0x400 <= c < 0x530 else "latin"


def normal(kind: str, mention: str) -> str:
    """What mentions of one entity have in common."""
    if kind in ("card", "phone", "iban", "ssn"):
        return "".join(c for c in mention if c.isalnum() or c == "+")
    return mention.lower() if kind in ("email", "surname", "given") else mention


def likely_gender(name: str) -> str:
    """The gender of a given name in normal form that no title tells: that of the list which has it,
    else by its last letter."""
    script = script_of(name)
    for gender in "mf":
        if name.capitalize() in GIVEN[script, gender]:
            return gender
    return "f" if name[-1] in {"latin": "aei", "cyrillic": "ая", "greek": "αάηήώ"}[script] else "m"


#: Letters that names are mostly of, by script; each becomes a syllable.
LETTERS = {"latin": _LOWER, "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюяё", "greek": "αβγδεζηθικλμνξοπρςστυφχψωάέήίόύώ"}


def spelt(name: str, key: bytes) -> str:
    """Syllables of the name's script for a name, one to one: a keyed permutation within its number
    of letters, or, for names with others, of bytes; these end with a further vowel."""
    script = script_of(name)
    consonants, vowels, _ = SYLLABLES[script]
    base, letters = len(consonants) * len(vowels), LETTERS[script]
    plain = all(c in letters for c in name)
    if plain:
        value, places = 0, len(name)
        for c in name:
            value = value * len(letters) + letters.index(c)
    else:
        data = name.encode()
        # more than one place a byte, so that their number tells the number of bytes
        value, places = int.from_bytes(data, "big"), math.ceil(len(data) * 8 / math.log2(base))
    value, out = permuted(value, base**places, key), []
    for _ in range(places):
        value, syllable = divmod(value, base)
        out.append(consonants[syllable // len(vowels)] + vowels[syllable % len(vowels)])
    return "".join(out) + ("" if plain else vowels[0])


def surrogate(kind: str, entity: str, key: bytes, draw: int = 0, gender: str = "") -> str:
    """The surrogate of an entity in normal form. kind: a type, given or surname; gender: a given
    name's, if it isn't the likely one. One to one for each format and draw."""
    keyed = hmac.new(key, f"{kind}:{draw}".encode(), hashlib.sha256).digest()
    if kind == "card" and luhn_digit(entity[:-1]) == entity[-1]:
        payload = entity[0] + same_format(entity[1:-1], keyed)
        return payload + luhn_digit(payload)
    if kind == "card":
        out = entity[0] + same_format(entity[1:], keyed)
        while luhn_digit(out[:-1]) == out[-1]:  # that the sum fails is part of the format
            out = entity[0] + same_format(out[1:], keyed)
        return out
    if kind == "ip":
        octets = [int(x) for x in entity.split(".")]
        value = permuted(int.from_bytes(bytes(octets), "big"), 1 << 32, keyed)
        return ".".join(str(b) for b in value.to_bytes(4, "big"))
    if kind == "email":
        local, _, domain = entity.partition("@")
        host, _, top = domain.rpartition(".")
        reserved = host == "example" or host.endswith(".example")
        fixed = f"{'example.' if reserved else ''}{top}"
        inner = host.removesuffix("example").removesuffix(".") if reserved else host
        made_local, _, made = same_format(f"{local}@{inner}", keyed).partition("@")
        return f"{made_local}@{made + '.' if made else ''}{fixed}"
    if kind == "phone":
        prefix = re.match(r"\+1(?=\d{10}$)|\+\d{2}|", entity)[0]
        rest = entity[len(prefix) :]
        at = rest.find("555", 3, 6) if prefix in ("+1", "") and len(rest) == 10 else -1
        if at == 3:  # an exchange for fiction stays one; area codes don't begin with 0 or 1
            area = str(2 + permuted(int(rest[0]) - 2, 8, keyed)) if rest[0] in "23456789" else rest[0]
            other = same_format(rest[1:3] + rest[6:], hmac.new(keyed, rest[:1].encode(), hashlib.sha256).digest())
            return prefix + area + other[:2] + "555" + other[2:]
        return prefix + same_format(rest, keyed)
    if kind == "iban":
        return entity[:2] + same_format(entity[2:], keyed)
    if kind == "key":
        cut = len(re.match(r"AKIA|ASIA|gh[pos]_|sk-", entity)[0])
        return entity[:cut] + same_format(entity[cut:], keyed)
    if kind == "secret":
        return same_format(entity, keyed, bool(re.fullmatch("[0-9a-f]+", entity)))
    if kind == "given":
        drawn = int.from_bytes(hmac.new(keyed, entity.encode(), hashlib.sha256).digest()[:8], "big")
        names = GIVEN[script_of(entity), gender or likely_gender(entity)]
        # a list has few names: what keeps two entities apart is spelt after it
        return names[drawn % len(names)].lower() + spelt(entity, keyed)
    if kind == "surname":
        return spelt(entity, keyed) + SYLLABLES[script_of(entity)][2][0]
    return same_format(entity, keyed)


def dressed(kind: str, mention: str, made: str) -> str:
    """A surrogate in the spelling of a mention: its separators, its capitals."""
    if kind in ("card", "phone", "iban", "ssn"):
        characters = iter(made)
        return "".join(next(characters) if c.isalnum() or c == "+" else c for c in mention)
    if kind == "email":
        return made.upper() if mention.isupper() else made
    if kind in ("surname", "given"):
        return made.upper() if mention.isupper() and len(mention) > 1 else made[:1].upper() + made[1:]
    return made


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, gender) of all entities, in order; gender: what a title tells of a given
    name, else empty. Names give their parts; parts that were met with a title are found again
    where they stand alone, a word that was both as a given name."""
    found, names = [], {}
    for m in _ANY.finditer(text):
        kind = m.lastgroup if m.lastgroup and m.lastgroup.startswith("t_") else next(g for g, v in m.groupdict().items() if v is not None and g.startswith("t_"))
        kind = kind[2:]
        if kind == "secret":
            found.append((m.start("secret"), m.end("secret"), "secret", ""))
        elif kind == "name":
            title, *parts = [(m.start() + x.start(), x[0]) for x in re.finditer(r"\S+", m[0])]
            for (at, part), of in zip(parts, ["given", "surname"][-len(parts) :], strict=True):
                found.append((at, at + len(part), of, TITLES[title[1].rstrip(".")] if of == "given" else ""))
                if names.get(part) != "given":
                    names[part] = of
        else:
            found.append((m.start(), m.end(), kind, ""))
    if names:
        spans = sorted(found)
        ends = [b for _, b, _, _ in spans]
        for m in re.finditer(rf"(?<!\w)(?:{'|'.join(map(re.escape, sorted(names, key=len, reverse=True)))})(?!\w)", text):
            at = bisect.bisect_right(ends, m.start())  # the first span that ends behind it
            if at == len(spans) or spans[at][0] >= m.end():
                found.append((m.start(), m.end(), names[m[0]], ""))
    return sorted(found)


def replace(text: str, key: bytes, exceptions: dict[tuple[str, str], tuple[int, str]]) -> tuple[str, list[str]]:
    """The text with its entities replaced, and their kinds in order. exceptions: the draw and the
    gender of entities that haven't those they have by themselves."""
    out, at, kinds = [], 0, []
    for start, end, kind, _ in mentions(text):
        entity = normal(kind, text[start:end])
        out += [text[at:start], dressed(kind, text[start:end], surrogate(kind, entity, key, *exceptions.get((kind, entity), ())))]
        kinds.append(kind)
        at = end
    return "".join([*out, text[at:]]), kinds


def entities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(kind, entity, gender) of all texts, each once; gender: that which most titles give a given
    name where it isn't the likely one, else empty."""

    def over(batches):
        for batch in batches:
            for part in slices(batch, 0):
                own: dict[tuple[str, str], int] = {}
                for t in part.column(0).to_pylist():
                    for a, b, kind, gender in mentions(t) if t and hinted(t) else ():
                        entity = kind, normal(kind, t[a:b])
                        own[entity] = own.get(entity, 0) + (gender == "m") - (gender == "f")
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.string()), pa.array([e for _, e in own], pa.string()), pa.array(own.values(), pa.int64())], names=["kind", "entity", "more_m"])

    @F.pandas_udf("string")
    def unlike(entity: pd.Series, told: pd.Series) -> pd.Series:
        return pd.Series([g if g and g != likely_gender(e) else "" for e, g in zip(entity, told, strict=True)], dtype=object)

    found = map_texts(df.select(text_col), over, "kind string, entity string, more_m bigint").groupBy("kind", "entity").agg(F.sum("more_m").alias("more_m"))
    told = F.when(F.col("more_m") > 0, "m").when(F.col("more_m") < 0, "f").otherwise("")
    return found.select("kind", "entity", unlike("entity", told).alias("gender"))


def drawn(found: DataFrame, key: bytes) -> DataFrame:
    """Adds draw, written: 0, or more where surrogates of a kind would agree. Of entities made alike,
    the least keeps its draw and the others get the next one, until all differ."""

    @F.pandas_udf("string")
    def made(kind: pd.Series, entity: pd.Series, draw: pd.Series, gender: pd.Series) -> pd.Series:
        return pd.Series([surrogate(*x) for x in zip(kind, entity, [key] * len(kind), draw, gender, strict=True)], dtype=object)

    held = found.withColumn("draw", F.lit(0))
    last = None
    while True:
        held = written(held.withColumn("made", made("kind", "entity", "draw", "gender")), "entities")
        if last is not None:
            discard(last)
        alike = held.groupBy("kind", "made").agg(F.min("entity").alias("keeps"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        alike = written(alike, "alike")
        if not alike.limit(1).count():
            discard(alike)
            return held.drop("made")
        last, again = held, held.join(alike, ["kind", "made"], "left")
        held = again.select("kind", "entity", "gender", (F.col("draw") + F.coalesce((F.col("entity") != F.col("keeps")).cast("int"), F.lit(0))).alias("draw"))


def replace_entities(df: DataFrame, key: bytes = KEY, text_col: str = "text") -> DataFrame:
    """df with the entities of its texts replaced, n_entities, and entity_kinds (their kinds in
    order, joined by commas). Columns of df of these names give way."""
    spark = df.sparkSession
    unlike = drawn(entities(df, text_col), key).where("draw > 0 or gender <> ''")
    few = unlike.limit(BROADCAST_ENTITIES + 1).count() <= BROADCAST_ENTITIES
    state = spark.sparkContext.broadcast({(r["kind"], r["entity"]): (r["draw"], r["gender"]) for r in unlike.collect()} if few else {})
    small_batches(spark)

    @F.pandas_udf("text string, n bigint, kinds string")
    def replaced(text: pd.Series, own: pd.Series) -> pd.DataFrame:
        rows = []
        for t, more in zip(text, own, strict=True):
            exceptions = state.value if more is None else {(x["kind"], x["entity"]): (x["draw"], x["gender"]) for x in more}
            out, kinds = replace(t, key, exceptions) if t and hinted(t) else ("", [])
            rows.append((out if kinds else None, len(kinds), ",".join(kinds)))
        return pd.DataFrame(rows, columns=["text", "n", "kinds"])

    df = df.drop("n_entities", "entity_kinds")
    exception = "array<struct<kind:string,entity:string,draw:int,gender:string>>"
    if few:
        df = df.withColumn("__own", F.lit(None).cast(exception))
    else:
        df = df.withColumn("__of", F.md5(F.encode(F.col(text_col), "utf-8")))
        df = df.join(_exceptions_of(df, unlike, text_col).withColumn("__own", F.col("__own").cast(exception)), "__of", "left")
    out = df.withColumn("__r", replaced(F.col(text_col), "__own"))
    columns = {text_col: F.coalesce("__r.text", text_col), "n_entities": F.coalesce("__r.n", F.lit(0).cast("long")), "entity_kinds": F.coalesce("__r.kinds", F.lit(""))}
    return out.withColumns(columns).drop("__r", "__own", "__of")


def _exceptions_of(df: DataFrame, unlike: DataFrame, text_col: str) -> DataFrame:
    """(__of, __own): by the digest of a text, those of its entities that are in unlike."""

    def over(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = [(of, kind, entity) for of, t in zip(*(c.to_pylist() for c in part.columns), strict=True) if t and hinted(t) for kind, entity in {(k, normal(k, t[a:b])) for a, b, k, _ in mentions(t)}]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["__of", "kind", "entity"])

    met = map_texts(df.select("__of", text_col), over, "__of string, kind string, entity string").distinct()
    return met.join(unlike, ["kind", "entity"]).groupBy("__of").agg(F.collect_list(F.struct("kind", "entity", "draw", "gender")).alias("__own"))


def op9_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = replace_entities(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "text", "n_entities", "entity_kinds")
