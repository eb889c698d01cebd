"""Personal data replaced by keyed surrogates.

Detected entities get a replacement of the same type and format, drawn by a keyed hash
of their normalised value: digits for digits and letters for letters in the same places,
a name of the same gender and script for a name. The same value gets the same surrogate
in every document, so references stay together. A collision check over all distinct
values keeps different values apart and no surrogate equal to a value that occurs: a
surrogate that is taken goes to the smallest value that drew it, and the others draw
again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from partloom.llm.expressions import bind, unused
from partloom.llm.storage import written

# Given names by gender and script, and family names by script (fixed values).
GIVEN = {
    ("f", "latin"): "Anna Maria Julia Laura Elena Sofia Clara Emma Alice Marta Nora Lucia "
    "Helena Paula Irene Teresa Monica Carla Diana Eva".split(),
    ("m", "latin"): "Peter Martin Lucas David Daniel Simon Victor Oscar Felix Hugo Leo Paul "
    "Robert Thomas Andreas Stefan Marco Pablo Louis Erik".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Ирина Нина Вера Юлия Дарья Софья".split(),
    ("m", "cyrillic"): "Иван Пётр Павел Сергей Андрей Олег Игорь Борис Фёдор Антон".split(),
}
FAMILY = {
    "latin": "Keller Moreau Santos Weber Fischer Laurent Garcia Lindholm Novak Rossi Bauer "
    "Martel Vega Hoffman Dubois Serrano Walker Bennett Carter Hayes".split(),
    "cyrillic": "Орлов Волков Громов Зимин Крылов Лебедев Морозов Соколов Титов Яшин".split(),
}
TITLES = {
    "f": "Mrs Ms Miss Madam Frau Madame Mme Señora Sra Госпожа".split(),
    "m": "Mr Sir Herr Monsieur Señor Sr Господин".split(),
}


# From which attempt on all characters of a secret or a mailbox are drawn and addresses leave
# network 10; after which attempt secrets and mailboxes grow by a character each; and after
# which one the numbers of a fixed length do.
SHAPED = 2
LONGER = 3
LAST = 15
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


@dataclass(frozen=True)
class Kind:
    """A type of entity: its pattern, and how many leading characters keep their value."""

    name: str
    pattern: str


_NAME_WORD = r"\p{Lu}[\p{Ll}'’\-]+"
_TITLE = "|".join(sorted(TITLES["f"] + TITLES["m"], key=len, reverse=True))
# In order of precedence where two patterns match at one place.
KINDS = (
    # Possessive, and only from the start of a run: else each run is read once a character.
    Kind(
        "email",
        r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]++@"
        # A domain has at most 63 characters between its dots; twelve parts bound the depth.
        r"[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,10}\.[A-Za-z]{2,63}",
    ),
    Kind(
        "secret",
        r"\bAKIA[0-9A-Z]{16}\b|\bgh[pousr]_[A-Za-z0-9]{20,}\b"
        r"|\b(?=[PpTtSsAa])(?i:(?:password|passwd|pwd|token|secret|api_?key)\b)\s*[=:]\s*"
        r"(?:\"[^\"\s]+\"|'[^'\s]+'|[^\s\"',;]*[^\s\"',;.])",
    ),
    Kind("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    Kind("card", r"(?=\d)(?<![\d.])\d{4}([ \-]?)\d{4}\1\d{4}\1\d{4}(?![\d.]\d)"),
    Kind("ssn", r"(?=\d)(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    Kind("ip", r"(?=\d)(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d)"),
    Kind(
        "phone",
        r"(?=[+(\d])(?<![\w+])(?:\+\d{1,3}[ .\-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .\-]\d{3,4}[ .\-]\d{3,4}(?!\d)"
        r"|\+(?<![\w+]\+)\d{8,14}(?!\d)",
    ),
    Kind("name", rf"(?=\p{{Lu}})\b(?:{_TITLE})\.? {_NAME_WORD}(?: {_NAME_WORD})?"),
)
# One group is a back reference; the numbering of the joined pattern keeps it first.
ENTITY = "|".join(
    f"(?:{k.pattern})" for k in sorted(KINDS, key=lambda k: k.name != "card")
)


def _kind(value: Column) -> Column:
    """The type of a detected entity."""
    out = None
    for kind in KINDS:
        test = value.rlike(rf"^(?:{kind.pattern})$")
        out = F.when(test, kind.name) if out is None else out.when(test, kind.name)
    return out.otherwise("phone")


def _normal(kind: Column, value: Column) -> Column:
    """The form in which two mentions of one entity are equal."""
    digits = F.regexp_replace(value, r"[^0-9]", "")
    return (
        F.when(kind == "email", F.lower(value))
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "phone", F.regexp_replace(value, r"[^0-9+]", ""))
        .when(kind == "iban", F.regexp_replace(value, " ", ""))
        .otherwise(value)
    )


def _draws(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """128 hexadecimal digits that the key, the entity and the attempt determine."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, normal, attempt.cast("string")), 512)


def _drawn(stream: Column, at: Column) -> Column:
    """A number below 256 for a place in a value."""
    return F.conv(F.substr(stream, F.pmod(at * 2, F.lit(126)) + 1, F.lit(2)), 16, 10).cast("int")


def _reshaped(value: Column, stream: Column, keep: Column, others: Column | None = None) -> Column:
    """Digits for digits and letters for letters, the first ``keep`` characters as they are.

    Where ``others`` holds, letters stand for all other characters too.
    """
    lower, upper = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def letter(letters: str, i: Column) -> Column:
        return F.substr(F.lit(letters), F.pmod(_drawn(stream, i), F.lit(26)) + 1, F.lit(1))

    return F.array_join(
        F.transform(
            F.split(value, ""),
            lambda c, i: F.when(i < keep, c)
            .when(c.rlike("^[0-9]$"), F.pmod(_drawn(stream, i), F.lit(10)).cast("string"))
            .when(c.rlike("^[a-z]$"), letter(lower, i))
            .when(c.rlike("^[A-Z]$"), letter(upper, i))
            .when(c.rlike(r"^\p{N}$"), F.pmod(_drawn(stream, i), F.lit(10)).cast("string"))
            .when(c.rlike(r"^\p{Lu}$"), letter(upper, i))
            .when(c.rlike(r"^\p{L}$") if others is None else others | c.rlike(r"^\p{L}$"), letter(lower, i))
            .otherwise(c),
        ),
        "",
    )


def _longer(stream: Column, count: Column, letters: str) -> Column:
    """So many further characters; none for a count below one."""
    more = F.sha2(F.concat(stream, F.lit("more")), 512)
    return F.when(
        count > 0,
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.greatest(count, F.lit(1))),
                lambda i: F.substr(
                    F.lit(letters), F.pmod(_drawn(more, i), F.lit(len(letters))) + 1, F.lit(1)
                ),
            ),
            "",
        ),
    ).otherwise("")


def _secret(normal: Column, stream: Column, attempt: Column) -> Column:
    """Name, sign and quotes kept; the value itself reshaped, and longer in late attempts."""
    head = F.regexp_extract(normal, r"^(?:AKIA|gh[pousr]_|[A-Za-z_]+\s*[=:]\s*[\"']?)", 0)
    quote = F.regexp_extract(head, r"[\"']$", 0)
    body = F.substr(normal, F.length(head) + 1, F.length(normal) - F.length(head) - F.length(quote))
    return F.concat(
        head,
        _reshaped(body, stream, F.lit(0), attempt >= SHAPED),
        _longer(stream, attempt - LONGER, ALPHABET),
        quote,
    )


def _luhn(digits: Column) -> Column:
    """The sum whose divisibility by ten makes a card number valid."""
    doubled = F.transform(
        F.reverse(F.split(digits, "")),
        lambda c, i: bind(
            c.cast("int") * F.when(i % 2 == 1, 2).otherwise(1),
            lambda d: F.when(d > 9, d - 9).otherwise(d),
        ),
    )
    return F.aggregate(doubled, F.lit(0), lambda a, b: a + b)


def _card(normal: Column, stream: Column) -> Column:
    """A number with the same first digit; valid as a card number if the original is."""
    body = F.substr(_reshaped(normal, stream, F.lit(1)), F.lit(1), F.lit(15))
    last = F.pmod(10 - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10))
    off = F.pmod(_drawn(stream, F.lit(40)), F.lit(9)) + 1
    valid = F.pmod(_luhn(normal), F.lit(10)) == 0
    check = F.when(valid, last).otherwise(F.pmod(last + off, F.lit(10)))
    return F.concat(body, check.cast("string"))


def _listed(names: list[str], stream: Column, at: Column) -> Column:
    drawn = _drawn(stream, at) * 256 + _drawn(stream, at + 1)
    return F.get(F.array(*[F.lit(n) for n in names]), F.pmod(drawn, F.lit(len(names))))


def _name(value: Column, stream: Column, attempt: Column) -> Column:
    """Title kept; given and family name of the same gender and script.

    Every second attempt adds a further family name, so that the names never run out.
    """
    title = F.regexp_extract(value, rf"^(?:{_TITLE})\.? ", 0)
    bare = F.regexp_replace(title, r"[. ]", "")
    woman = bare.isin(TITLES["f"])
    cyrillic = value.rlike(r"\p{IsCyrillic}[^ ]*$")

    def choice(script: str) -> Column:
        given = F.when(woman, _listed(GIVEN["f", script], stream, F.lit(0))).otherwise(
            _listed(GIVEN["m", script], stream, F.lit(0))
        )
        families = F.array_join(
            F.transform(
                F.sequence(F.lit(1), F.floor(attempt / 2).cast("int") + 1),
                lambda i: _listed(FAMILY[script], stream, i * 2),
            ),
            "-",
        )
        both = F.size(F.split(value, " ")) > 2
        return F.concat(F.when(both, F.concat(given, F.lit(" "))).otherwise(""), families)

    return F.concat(title, F.when(cyrillic, choice("cyrillic")).otherwise(choice("latin")))


def _surrogate(key: str, kind: Column, normal: Column, attempt: Column) -> Column:
    """The replacement of a normalised value."""

    def made(stream: Column) -> Column:
        octets = [F.pmod(_drawn(stream, F.lit(i)), F.lit(256)).cast("string") for i in range(3)]
        network = F.when(attempt < SHAPED, 10).otherwise(
            F.pmod(_drawn(stream, F.lit(3)), F.lit(223)) + 1
        )
        digits = _longer(stream, attempt - LAST, "0123456789")
        address = F.split(normal, "@")
        # Mailboxes of one domain keep one domain.
        domain = F.get(address, 1)
        body = F.regexp_extract(domain, r"^(.*)\.[^.]+$", 1)
        ending = F.regexp_extract(domain, r"(\.[^.]+)$", 1)
        moved = F.concat(
            _reshaped(body, _draws(key, F.lit("domain"), domain, F.lit(0)), F.lit(0)), ending
        )
        return (
            F.when(
                kind == "email",
                F.concat(
                    _reshaped(F.get(address, 0), stream, F.lit(0), attempt >= SHAPED),
                    _longer(stream, attempt - LONGER, ALPHABET),
                    F.lit("@"),
                    moved,
                ),
            )
            .when(kind == "card", F.concat(_card(normal, stream), digits))
            .when(
                kind == "ip",
                F.concat(
                    F.concat_ws(".", network.cast("string"), *octets),
                    F.when(digits != "", F.concat(F.lit(":"), digits)).otherwise(""),
                ),
            )
            .when(kind == "iban", F.concat(_reshaped(normal, stream, F.lit(2)), digits))
            .when(kind == "secret", _secret(normal, stream, attempt))
            .when(kind == "name", _name(normal, stream, attempt))
            # The first digit of an international number stays: it names the region.
            .when(normal.startswith("+"), F.concat(_reshaped(normal, stream, F.lit(2)), digits))
            .otherwise(F.concat(_reshaped(normal, stream, F.lit(0)), digits))
        )

    return bind(_draws(key, kind, normal, attempt), made)


def _formatted(kind: Column, value: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own punctuation, spacing and case."""
    chars = F.split(value, "")
    digit_places = bind(
        chars,
        lambda cs: F.transform(
            cs,
            lambda c, i: F.when(
                c.rlike("^[0-9]$"),
                F.substr(
                    F.regexp_replace(surrogate, "[^0-9]", ""),
                    F.size(F.filter(F.slice(cs, F.lit(1), i + 1), lambda x: x.rlike("^[0-9]$"))),
                    F.lit(1),
                ),
            ).otherwise(c),
        ),
    )
    spaced = F.array_join(F.transform(F.split(value, " "), lambda p, i: F.substr(surrogate, i * 4 + 1, F.length(p))), " ")
    # What a late attempt has added follows the places of the mention.
    places = F.length(F.regexp_replace(value, "[^0-9]", ""))
    added = F.substr(F.regexp_replace(surrogate, "[^0-9]", ""), places + 1, F.length(surrogate))
    tail = F.substr(surrogate, F.length(F.regexp_replace(value, " ", "")) + 1, F.length(surrogate))
    return (
        F.when(
            kind.isin("card", "ssn", "phone"), F.concat(F.array_join(digit_places, ""), added)
        )
        .when((kind == "iban") & F.contains(value, F.lit(" ")), F.concat(spaced, tail))
        .when((kind == "email") & value.rlike("^[^a-z]+$"), F.upper(surrogate))
        .otherwise(surrogate)
    )


def _mentions(documents: DataFrame) -> DataFrame:
    """Rows (doc_id, text_hash, pos, kind, value, normal), one for each mention."""
    found = F.regexp_extract_all("text", F.lit(ENTITY), F.lit(0))
    each = documents.select(
        "doc_id", F.xxhash64("text").alias("text_hash"), F.posexplode(found).alias("pos", "value")
    )
    kinds = each.withColumn("kind", _kind(F.col("value")))
    return kinds.withColumn("normal", _normal(F.col("kind"), F.col("value")))


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """Rows (kind, normal, surrogate) for the distinct rows (kind, normal).

    Within a kind all surrogates differ, and none equals a value that occurs. Each round
    settles the smallest value of every surrogate that is free; the others draw again.
    The surrogates that a value can draw grow without bound in the attempt (further family
    names, letters for other characters, more length), so the rounds end.
    """
    originals = entities.select("kind", F.col("normal").alias("surrogate"))
    open_rows = entities.withColumn("attempt", F.lit(0))
    settled: DataFrame | None = None
    while True:
        drawn = open_rows.withColumn(
            "surrogate", _surrogate(key, F.col("kind"), F.col("normal"), F.col("attempt"))
        )
        free = drawn.join(originals, ["kind", "surrogate"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = written(
            free.groupBy("kind", "surrogate")
            .agg(F.min("normal").alias("normal"))
            .select("kind", "normal", "surrogate"),
            "surrogates",
        )
        settled = won if settled is None else settled.unionByName(won)
        open_rows = written(
            open_rows.join(won, ["kind", "normal"], "left_anti").withColumn(
                "attempt", F.col("attempt") + 1
            ),
            "open",
        )
        if open_rows.isEmpty():
            return settled


def replaced(documents: DataFrame, key: str) -> DataFrame:
    """The columns of ``documents`` with every detected entity replaced in text.

    Types: email, secret, iban, card, ssn, ip, phone, and names after a title. Added
    columns: n_entities, and entity_kinds (sorted distinct types). An n_chars column is
    counted anew where the text changes. Null and empty texts stay as they are. Rows
    that share doc_id and text get the same result as often as they come; a null doc_id
    is a value like others. Columns n_entities and entity_kinds are replaced.
    """
    names = [c for c in documents.columns if c not in ("n_entities", "entity_kinds")]
    mentions = written(_mentions(documents), "mentions")
    mapping = surrogates(mentions.select("kind", "normal").distinct(), key)
    spoken = mentions.join(mapping, ["kind", "normal"]).withColumn(
        "said", _formatted(F.col("kind"), F.col("value"), F.col("surrogate"))
    )
    hashed, owner, of, heard, kinds = unused(names, "_hash", "_id", "_of", "_said", "_kinds")
    gathered = spoken.groupBy(
        F.col("doc_id").alias(owner), F.col("text_hash").alias(of)
    ).agg(
        F.array_sort(F.collect_set(F.struct("pos", "said"))).alias(heard),
        F.array_sort(F.collect_set("kind")).alias(kinds),
    )
    marked = documents.select(*names, F.xxhash64("text").alias(hashed))
    gaps = F.split("text", ENTITY, -1)
    said = F.transform(F.col(heard), lambda s: s["said"])
    text = F.array_join(
        F.flatten(
            F.zip_with(gaps, said, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))
        ),
        "",
    )
    joined = marked.join(
        gathered, F.col("doc_id").eqNullSafe(F.col(owner)) & (F.col(hashed) == F.col(of)), "left"
    )
    found = F.col(heard).isNotNull()
    columns = {c: F.col(c) for c in names}
    columns["text"] = F.when(found, text).otherwise(F.col("text"))
    if "n_chars" in columns:
        length = F.length(text).cast(documents.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(found, length).otherwise(F.col("n_chars"))
    no_kinds = F.array().cast("array<string>")
    return joined.select(
        *[column.alias(c) for c, column in columns.items()],
        F.when(found, F.size(heard)).otherwise(0).cast("long").alias("n_entities"),
        F.coalesce(kinds, no_kinds).alias("entity_kinds"),
    )
