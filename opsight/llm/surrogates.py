"""Personal data replaced by keyed surrogates of the same type and format.

Found are e-mail and network addresses, telephone numbers, card-like numbers, credentials and titled names. An entity is
known by its type and canonical form (digits, lower case), so different spellings of it get the same surrogate. The
surrogate is a keyed permutation of the canonical form within its format: letters stay letters of their script, digits
digits, valid check digits valid; the spelling is then put back. Names are built from syllables of the script with an
ending for the gender of the title.

Collision checks keep entities distinct: all entities of the corpus are compared, and where a surrogate is taken twice
or is itself an entity of the corpus, all but one of the holders get another attempt. Compared is what shows in the text,
so the same made-up word is not given to two people of different titles; names get longer with the attempt. Where that
does not end, the corpus holds most values of a format, and no surrogate can be new: all entities of such a format then
get one keyed permutation without fixed points, which keeps them distinct by itself, and all others keep clear of those.
The first attempt needs no table, so only exceptions are joined back (as a broadcast where they are few, else by text).

A full name found with a title is also replaced where the same text repeats it without one. A month and year (05/2023)
is not a telephone number. Letters of other alphabets than those below stay in addresses and credentials; an entity
without any letter or digit of them stays as it is.

Null texts stay null, empty ones empty. Repeated rows get the same text. Overlapping finds: the earlier, then the longer
one counts. Extra columns pass through; `n_chars` follows the new text where the table has it. Empty table: no rows.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opsight.llm.common import in_slices, stored

KEY = "surrogates"
FEW = 100_000
#: Attempts before the formats that still collide are permuted as a whole.
ROUNDS = 12
#: The attempt number of such a permutation.
WHOLE = -1

PATTERNS = {
    "email": r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)+",
    "secret": r"(?i:pass(?:word|wd)|secret|token|api[_-]?key)[\"']?\s*[:=]\s*[\"']?[^\s\"']{8,}",
    "ip": r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w.]*\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
    # national forms: (555) 123-4567, 555-123-4567, 0171 5557713, 030 123 45 67
    r"|(?<![\w+.-])(?<!\d )(?:\(\d{2,5}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\d{3}[ .-]\d{3}[ .-]\d{4}|(?!0[1-9](?:/(?:1[5-9]|20)\d\d(?!\d)|[ -](?:1[5-9]|20)\d\d(?![ -]?\d)))0\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,4}){0,3})(?![ .-]?\d|\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w+])\d(?:[ -]?\d){12,18}(?![\w])",
    "name": r"(?:Mr|Mrs|Ms|Miss|Dr|Herr|Frau|Sra|Sr|Monsieur|Madame|Mme|г-н|г-жа)\.? [^\W\d_a-zа-я][^\W\d_]+(?: [^\W\d_a-zа-я][^\W\d_]+)?",
}
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Sra", "Madame", "Mme", "г-жа")
MALE_TITLES = ("Mr", "Herr", "Sr", "Monsieur", "г-н")
_FIND = re.compile("|".join(f"(?P<{k}>{v})" for k, v in PATTERNS.items()))
_HINT = re.compile(r"[@\d]|Mr|Ms|Miss|Mme|Dr|Herr|Frau|Sr|M[oa]|г-")
#: Country codes of one and two digits; all others have three.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")
_SECRET_VALUE = re.compile(r"[:=]\s*[\"']?")

ALPHABETS = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "αβγδεζηθικλμνξοπρστυφχψω",
]
_CLASS = {c: a for a in ALPHABETS for c in a}
_HEX = "0123456789abcdef"
SYLLABLES = {
    "latin": (["ba", "de", "li", "mo", "nu", "ra", "se", "ti", "vo", "ka", "ne", "lo", "mi", "ru", "sa", "te"], {"f": "a", "m": "o", "": "i"}),
    "cyrillic": (["ба", "де", "ли", "мо", "ну", "ра", "се", "ти", "во", "ка", "не", "ло", "ми", "ру", "са", "те"], {"f": "на", "m": "н", "": "й"}),
    "greek": (["βα", "δε", "λι", "μο", "νυ", "ρα", "σε", "τι", "φο", "κα", "νε", "λο", "μι", "ρυ", "σα", "τε"], {"f": "να", "m": "νο", "": "νι"}),
}


def _draw(key: str, *parts: object) -> int:
    digest = hashlib.blake2b("\x1f".join(map(str, parts)).encode(), digest_size=16, key=key.encode()[:64]).digest()
    return int.from_bytes(digest, "big")


def _rounds(numbers: list[int], sizes: list[int], key: str, tweak: object, back: bool = False) -> None:
    """Unbalanced Feistel rounds over two numbers below `sizes`, in place, or the same rounds undone."""
    for r in reversed(range(8)) if back else range(8):
        side = (r + 1) % 2
        drawn = _draw(key, tweak, r, numbers[1 - side])
        numbers[side] = (numbers[side] + (-drawn if back else drawn)) % sizes[side]


def _moved(numbers: list[int], sizes: list[int], key: str, tweak: object, whole: bool) -> None:
    """A bijection on pairs of numbers; with `whole` one without fixed points: a step on the cycle that the rounds define."""
    _rounds(numbers, sizes, key, tweak)
    if whole:
        step = (numbers[0] * sizes[1] + numbers[1] + 1) % (sizes[0] * sizes[1])
        numbers[:] = divmod(step, sizes[1])
        _rounds(numbers, sizes, key, tweak, back=True)


def _kinds(value: str, alphabets: list[str] | None = None) -> tuple[list[str], str]:
    """The alphabet of each character, and the format that they make with the characters that stay."""
    kinds = alphabets or [_CLASS.get(c, "") for c in value]
    return kinds, "".join(k[0] if k else c for k, c in zip(kinds, value, strict=True))


def permuted(value: str, tweak: str, key: str, alphabets: list[str] | None = None, whole: bool = False) -> str:
    """A bijection on strings of one format: the two halves are moved as mixed-radix numbers."""
    kinds, mask = _kinds(value, alphabets)
    at = [i for i, k in enumerate(kinds) if k]
    if not at:
        return value
    halves = at[: len(at) // 2], at[len(at) // 2 :]
    sizes, numbers = [], []
    for half in halves:
        number, size = 0, 1
        for i in half:
            number, size = number * len(kinds[i]) + kinds[i].index(value[i]), size * len(kinds[i])
        sizes.append(size)
        numbers.append(number)
    _moved(numbers, sizes, key, f"{tweak}\x1f{mask}", whole)
    out = list(value)
    for half, number in zip(halves, numbers, strict=True):
        for i in reversed(half):
            number, digit = divmod(number, len(kinds[i]))
            out[i] = kinds[i][digit]
    return "".join(out)


def luhn(digits: str) -> str:
    """The check digit for these digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def _script(word: str) -> str:
    word = word.lower()
    return "cyrillic" if any("а" <= c <= "я" for c in word) else "greek" if any("α" <= c <= "ω" for c in word) else "latin"


def _gender(title: str) -> str:
    return "f" if title in FEMALE_TITLES else "m" if title in MALE_TITLES else ""


def find(text: str | None) -> list[tuple[str, int, int, str]]:
    """(type, start, end, canonical form) of the entities of a text, in order."""
    if not text or not _HINT.search(text):
        return []
    out = []
    for m in _FIND.finditer(text):
        kind, start, end = m.lastgroup, m.start(), m.end()
        value = m.group()
        if kind == "secret":
            start += _SECRET_VALUE.search(value).end()
            value = text[start:end].rstrip(".,;#*$%&")
            end = start + len(value)
            if len(value) < 8 or not any(map(str.isdigit, value)):
                continue
        elif kind == "name":
            title, _, rest = value.partition(" ")
            start, value = end - len(rest), _gender(title.rstrip(".")) + "|" + rest.lower()
            out.append((kind, start, end, value))
            continue
        elif kind == "ip":
            if any(int(x) > 255 for x in value.split(".")):
                continue
            value = ".".join(str(int(x)) for x in value.split("."))
        elif kind in ("phone", "ssn", "card"):
            value = "".join(filter(str.isdigit, value))
            if kind == "phone":
                # the digits that stay: the country code, or the zero before a national number
                kept = len(_COUNTRY.match(value).group()) if m.group()[0] == "+" and value[0] != "0" else int(value[0] == "0")
                value = f"{kept}|{value}" if m.group()[0] == "+" else f"{kept}|n|{value}"
        elif kind == "email":
            value = value.lower()
        out.append((kind, start, end, value))
    return _with_repeats(text, out)


def _with_repeats(text: str, found: list[tuple[str, int, int, str]]) -> list[tuple[str, int, int, str]]:
    """The finds, and the places where the text repeats a full name of them without its title."""
    names = {text[start:end]: value for kind, start, end, value in reversed(found) if kind == "name" and " " in value}
    if not names:
        return found
    out, n = [], 0
    repeats = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(names, key=len, reverse=True))) + r")(?!\w)")
    for m in repeats.finditer(text):
        while n < len(found) and found[n][2] <= m.start():
            out.append(found[n])
            n += 1
        if n == len(found) or found[n][1] >= m.end():
            out.append(("name", m.start(), m.end(), names[m.group()]))
    return out + found[n:]


@functools.lru_cache(maxsize=50_000)
def surrogate(kind: str, canonical: str, attempt: int, key: str) -> str:
    """The canonical form of the surrogate."""
    tweak, whole = f"{kind}/{attempt}", attempt == WHOLE
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels, dot, top = domain.rpartition(".")
        # a local part without letters to change leaves the change to the domain
        fixed = whole and not any(_kinds(local)[0])
        return permuted(local, tweak, key, whole=whole) + "@" + permuted(labels, "domain", key, whole=fixed) + dot + top
    if kind == "ip":
        a, b, c, d = map(int, canonical.split("."))
        halves = [a * 256 + b, c * 256 + d]
        _moved(halves, [65536, 65536], key, tweak, whole)
        return ".".join(str(x) for h in halves for x in divmod(h, 256))
    if kind == "phone":
        head, _, digits = canonical.rpartition("|")
        n = min(int(head[0]), len(digits) - 4)
        return f"{head}|{digits[:n]}{permuted(digits[n:], f'{tweak}/{digits[:n]}', key, whole=whole)}"
    if kind == "card":
        # an invalid number stays invalid: the check digit keeps its distance from the valid one
        apart = int(canonical[-1]) - int(luhn(canonical[:-1]))
        body = canonical[0] + permuted(canonical[1:-1], tweak, key, whole=whole)
        return body + str((int(luhn(body)) + apart) % 10)
    if kind == "secret":
        lower = canonical.lower()
        return permuted(lower, tweak, key, _secret_alphabets(lower), whole)
    if kind == "name":
        gender, _, words = canonical.partition("|")
        made = []
        for i, word in enumerate(words.split(" ")):
            parts, endings = SYLLABLES[_script(word)]
            number = _draw(key, tweak, word, i)
            # each attempt adds a syllable, so the space outgrows any number of names
            stem = "".join(parts[(number >> (4 * k)) % 16] for k in range(min(3 + attempt + (number >> 64) % 2, 30)))
            made.append(stem + (endings[gender] if i == 0 and " " in words else endings[""] if " " in words else "s"))
        return gender + "|" + " ".join(made)
    return permuted(canonical, tweak, key, whole=whole)


def _secret_alphabets(lower: str) -> list[str] | None:
    return [_HEX] * len(lower) if set(lower) <= set(_HEX) else None


def format_of(kind: str, canonical: str) -> str | None:
    """The set of values within which an entity's surrogates stay; None for names, which can always get longer."""
    if kind == "name":
        return None
    if kind == "ip":
        return kind
    if kind == "email":
        local, _, domain = canonical.partition("@")
        labels, dot, top = domain.rpartition(".")
        own = _kinds(local)[1]
        return f"{kind}|{own}@{labels if any(_kinds(local)[0]) else _kinds(labels)[1]}{dot}{top}"
    if kind == "phone":
        head, _, digits = canonical.rpartition("|")
        n = min(int(head[0]), len(digits) - 4)
        return f"{kind}|{head}|{digits[:n]}|{len(digits)}"
    if kind == "card":
        return f"{kind}|{canonical[0]}|{len(canonical)}|{(int(canonical[-1]) - int(luhn(canonical[:-1]))) % 10}"
    return f"{kind}|{_kinds(canonical.lower(), _secret_alphabets(canonical.lower()) if kind == 'secret' else None)[1]}"


def spelled(kind: str, original: str, made: str) -> str:
    """A canonical surrogate in the spelling of the original."""
    if kind in ("phone", "ssn", "card"):
        digits = iter(made.rpartition("|")[2])
        return "".join(next(digits) if c.isdigit() else c for c in original)
    if kind == "name":
        return " ".join(w.upper() if o.isupper() and len(o) > 1 else w.capitalize() for o, w in zip(original.split(" "), made.partition("|")[2].split(" "), strict=True))
    if kind == "ip" or len(made) != len(original):
        return made
    return "".join(m.upper() if o.isupper() else m for o, m in zip(original, made, strict=True))


def replaced(text: str | None, attempts: dict[tuple[str, str], int], key: str) -> tuple[str | None, int]:
    found = find(text)
    if not found:
        return text, 0
    parts, at = [], 0
    for kind, start, end, canonical in found:
        made = surrogate(kind, canonical, attempts.get((kind, canonical), 0), key)
        parts += [text[at:start], spelled(kind, text[start:end], made)]
        at = end
    return "".join(parts) + text[at:], len(found)


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """Distinct (kind, canonical) of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            found = {(kind, canonical) for v in batch.column(0) for kind, _, _, canonical in find(v.as_py())}
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[i] for f in found], pa.string()) for i in range(2)], names=["kind", "canonical"]
            )

    return docs.select(text).mapInArrow(run, "kind string, canonical string").distinct()


def _written(kind: str, canonical: str) -> str:
    """A canonical form as it shows in a text: the gender of a name and the length of a country code do not."""
    return canonical.rpartition("|")[2] if kind in ("name", "phone") else canonical


def _with_surrogates(table: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = list(zip(*[batch.column(n).to_pylist() for n in ("kind", "canonical", "attempt")], strict=True))
            made = [surrogate(k, c, a, key) for k, c, a in rows]
            shown = [_written(r[0], m) for r, m in zip(rows, made, strict=True)]
            real = [_written(k, c) for k, c, _ in rows]
            forms = [format_of(k, c) for k, c, _ in rows]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(x, pa.string()) for x in (made, shown, real, forms)]],
                names=[*batch.schema.names, "made", "shown", "written", "form"],
            )

    schema = "kind string, canonical string, attempt int, made string, shown string, written string, form string"
    return table.select("kind", "canonical", "attempt").mapInArrow(run, schema)


def assigned(docs: DataFrame, text: str = "text", key: str = KEY) -> DataFrame:
    """kind, canonical, attempt, made for every entity, without collisions."""
    now = stored(_with_surrogates(entities(docs, text).withColumn("attempt", F.lit(0)), key), "entities")
    rounds = 0
    while True:
        # one holder keeps a surrogate: a format permuted as a whole, then the one of the fewest attempts, then the smallest
        holders = now.groupBy("kind", "shown").agg(F.min(F.struct("attempt", "canonical"))["canonical"].alias("holder"))
        real = now.select("kind", F.col("written").alias("shown"), F.lit(True).alias("real")).distinct()
        checked = now.join(holders, ["kind", "shown"]).join(real, ["kind", "shown"], "left")
        clash = (F.col("attempt") != WHOLE) & ((F.col("holder") != F.col("canonical")) | F.col("real").isNotNull())
        checked = stored(checked.withColumn("clash", clash), "clashes")
        if not checked.where("clash").limit(1).count():
            return now.select("kind", "canonical", "attempt", "made")
        rounds += 1
        again = checked.withColumn("attempt", F.col("attempt") + F.col("clash").cast("int"))
        if rounds % ROUNDS == 0:
            # every time at least one more format is settled for good, or only names are left, which get longer
            full = checked.where("clash AND form IS NOT NULL").select("form", F.lit(True).alias("full")).distinct()
            again = again.join(full, "form", "left").withColumn("attempt", F.when(F.col("full"), WHOLE).otherwise(F.col("attempt")))
        now = stored(_with_surrogates(again, key), "entities")


def replace_all(docs: DataFrame, text: str = "text", key: str = KEY, few: int = FEW) -> DataFrame:
    """All rows and columns with replaced texts, and the number of entities as `__entities`."""
    again = assigned(docs, text, key).where("attempt <> 0").select("kind", "canonical", "attempt")
    kind = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("canonical", T.StringType()), T.StructField("attempt", T.IntegerType())]))
    table: dict[tuple[str, str], int] = {}
    if again.limit(few + 1).count() <= few:
        table = {(r["kind"], r["canonical"]): r["attempt"] for r in again.toLocalIterator()}
        docs = docs.withColumn("__again", F.lit(None).cast(kind))
    else:
        by_text = _occurrences(docs, text).join(again, ["kind", "canonical"]).groupBy("__text").agg(
            F.collect_set(F.struct("kind", "canonical", "attempt")).alias("__again")
        )
        docs = docs.withColumn("__text", F.md5(F.col(text).cast("binary"))).join(by_text, "__text", "left").drop("__text")
    shared = docs.sparkSession.sparkContext.broadcast(table)
    schema = T.StructType([*[f for f in docs.schema.fields if f.name != "__again"], T.StructField("__entities", T.LongType())])
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            made = []
            for value, own in zip(batch.column(at), batch.column("__again"), strict=True):
                attempts = shared.value | {(x["kind"], x["canonical"]): x["attempt"] for x in own.as_py()} if own.is_valid else shared.value
                made.append(replaced(value.as_py(), attempts, key))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            del columns["__again"]
            columns[text] = pa.array([m[0] for m in made], pa.string())
            yield pa.RecordBatch.from_arrays([*columns.values(), pa.array([m[1] for m in made], pa.int64())], names=[*columns, "__entities"])

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def _occurrences(docs: DataFrame, text: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in in_slices(batches):
            rows = [(k, kind, c) for k, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for kind, _, _, c in find(v.as_py())]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["__text", "kind", "canonical"]
            )

    keyed = docs.select(F.md5(F.col(text).cast("binary")).alias("__text"), F.col(text).alias("text"))
    return keyed.mapInArrow(run, "__text string, kind string, canonical string").distinct()
