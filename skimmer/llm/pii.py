"""PII surrogates: detected entities get keyed, type-consistent replacements.

A surrogate depends on the key, the kind and the entity's canonical form only, so all
mentions of an entity, in any document and spelling, stay linked; of a name that a title
gives away in a document, mentions without the title are replaced there too, in full or
by surname.  Formats stay: digits become digits, vowels vowels and consonants consonants
of the same case and script; separators, country codes, titles and top-level domains
stay, card numbers and IBANs keep their check digits valid, addresses stay valid, and
given names follow the gender of the title.  Surrogates of all distinct entities are
checked against each other and against the entities themselves; colliding ones are drawn
again, from wider shapes if need be.  DataFrame operations only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, written

# Titles by gender, and what stands for letters of each script.
MALE = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Господин", "Κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Госпожа", "Κυρία")
NEUTRAL = ("Dr", "Prof")
ALPHABETS = (
    (r"[0-9]", "0123456789"),
    (r"(?iu)[аеёиоуыэюя]", "аеиоуюя"),
    (r"\p{IsCyrillic}", "бвгджзклмнпрстфхчш"),
    (r"(?iu)[αεηιουωάέήίόύώ]", "αεηιουω"),
    (r"\p{IsGreek}", "βγδζθκλμνξπρστφχψ"),
    (r"(?iu)[aeiouyàáâãäåæèéêëìíîïòóôõöøùúûüý]", "aeiou"),
    (r"\p{L}", "bcdfghjklmnprstvwz"),
)
GIVEN = {
    "male Latin": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Marco Noel Oscar Paul Anton Boris Daniel Erik Frank Gustav Henrik Isaac Jakob Konrad Lukas Martin Niklas Otto Peter Robert".split(),
    "female Latin": "Anna Berta Clara Dora Elsa Frida Greta Helena Ida Julia Klara Laura Maria Nora Olga Paula Agnes Beata Cora Diana Emma Flora Gerda Hanna Irene Johanna Karin Lena Marta Nina Petra Rosa".split(),
    "male Cyrillic": "Иван Олег Пётр Юрий Антон Борис Виктор Денис Егор Игорь Кирилл Леонид Максим Никита Павел Роман".split(),
    "female Cyrillic": "Анна Вера Ольга Юлия Алла Дарья Елена Жанна Зоя Инна Ксения Лариса Мария Нина Полина Раиса".split(),
    "male Greek": "Νίκος Γιώργος Πέτρος Άρης Αλέξης Βασίλης Γιάννης Δημήτρης Κώστας Λευτέρης Μάριος Παύλος".split(),
    "female Greek": "Ελένη Μαρία Σοφία Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Κατερίνα Λουκία Μαρίνα Χριστίνα".split(),
}

_TITLE = "|".join((*MALE, *FEMALE, *NEUTRAL))
#: A capitalised word of a name, without the ending 's.
_WORD = r"\p{Lu}(?=[\p{L}'-])\p{L}*(?:['-](?!s(?!\p{L}))\p{L}+)*"
#: kind, pattern; at one place the first that fits counts.
KINDS = (
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]{1,63}+(?:\.[\p{L}\p{N}-]{1,63}+){1,8}"),
    ("ip", r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\d]|\.\d)"),
    ("card", r"(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}|\d{13,19})(?!\d)"),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("phone", r"(?<![\d+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\d)"),
    ("iban", r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])"),
    ("name", rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_WORD}(?: {_WORD}){{0,2}}"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
#: Cheaper than PATTERN, and found in every text that PATTERN is found in.
HINT = rf"@|\d[ .()-]{{0,2}}\d[ .()-]{{0,2}}\d|[A-Z]{{2}}\d\d|(?=[{''.join(sorted({t[0] for t in (*MALE, *FEMALE, *NEUTRAL)}))}])(?:{_TITLE})\.? \p{{Lu}}"


@dataclass(frozen=True)
class PiiParams:
    """key is the secret that surrogates derive from; it has no default.

    Every ``widen`` draws the shape of a colliding surrogate gets wider (a letter or digit
    or given name more, a kept prefix less), so that the space can't run out; rounds only
    ends a search that another error keeps going.
    """

    key: str
    widen: int = 8
    rounds: int = 200

    def __post_init__(self) -> None:
        if not self.key:
            raise ValueError("surrogates need a secret key")


def _kind(value: Column) -> Column:
    out = F.lit("name")
    for kind, pattern in reversed(KINDS):
        out = F.when(F.regexp_like(value, F.lit(f"^(?:{pattern})$")), kind).otherwise(out)
    return out


def canonical(kind: Column, value: Column) -> Column:
    """What equal mentions share: lower case, and for numbers only their digits and letters; a name without its title."""
    bare = F.regexp_replace(value, rf"^(?:{_TITLE})\.? ", "")
    return F.when(kind == "name", F.lower(bare)).when(kind.isin("email", "ip"), F.lower(value)).otherwise(F.lower(F.regexp_replace(value, r"[^\p{L}\p{N}+]", "")))


def _stream(p: PiiParams, *parts: Column) -> Column:
    """64 keyed bytes in hex."""
    return F.sha2(F.concat_ws("\x1f", F.lit(p.key), *parts, F.lit(p.key)), 512)


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substr(stream, F.pmod(i, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _bound(value: Column, body) -> Column:
    """body(value) with value computed once a row, as a lambda variable, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _shaped(value: Column, stream: Column, keep: Column) -> Column:
    """value with each digit and letter past the first ``keep`` redrawn from its own script and sound, case kept.

    A character's draw counts letters and digits only, so that separators don't matter.
    """
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    bare = lambda i: F.length(F.regexp_replace(F.substr(value, F.lit(1), i), r"[^\p{L}\p{N}]", ""))

    def alphabet(c: Column) -> Column:
        out = F.lit("")
        for pattern, letters in reversed(ALPHABETS):
            out = F.when(F.regexp_like(c, F.lit(f"^(?:{pattern})$")), letters).otherwise(out)
        return out

    def one(x: Column, s: Column) -> Column:
        letter = F.substr(x.a, F.pmod(_byte(s, x.n), F.length(x.a)) + 1, F.lit(1))
        return F.when(x.a == "", x.c).otherwise(F.when(F.regexp_like(x.c, F.lit(r"^\p{Lu}$")), F.upper(letter)).otherwise(letter))

    each = F.transform(chars, lambda c, i: F.struct(c.alias("c"), F.when(i < keep, "").otherwise(alphabet(c)).alias("a"), bare(i).alias("n")))
    return _bound(stream, lambda s: F.array_join(F.transform(each, lambda x: one(x, s)), ""))


def _luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last one undoubled."""
    places = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.struct(F.substr(digits, i, F.lit(1)).cast("int").alias("d"), F.pmod(F.length(digits) - i, F.lit(2)).alias("twice")))
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.when(x.twice == 0, x.d).otherwise(F.when(x.d > 4, x.d * 2 - 9).otherwise(x.d * 2)))


def _gender(value: Column) -> Column:
    """What a mention's title says, null for none or a neutral one."""
    title = F.regexp_replace(F.regexp_extract(value, rf"^(?:{_TITLE})\.? ", 0), r"[. ]", "")
    return F.when(title.isin(*MALE), "male").when(title.isin(*FEMALE), "female")


def _code(value: Column) -> Column:
    """Digits of the country code that a separator ends, null for none."""
    code = F.length(F.regexp_extract(value, r"^\+(\d{1,3})(?=[ .(-])", 1))
    return F.when(code > 0, code)


def _iban_rest(iban: Column) -> Column:
    """The number that an IBAN without spaces stands for, modulo 97: 1 if it is valid."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substr(iban, F.lit(1), F.lit(4)))
    chars = F.filter(F.split(F.upper(turned), ""), lambda c: c != "")
    value = lambda c: F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(chars, F.lit(0), lambda a, c: F.pmod(a * F.when(F.ascii(c) < 58, 10).otherwise(100) + value(c), F.lit(97)))


def _last(value: Column) -> Column:
    """The last word of a name."""
    return F.element_at(F.split(value, " "), -1)


def drawn(forms: DataFrame, p: PiiParams) -> DataFrame:
    """forms (kind, canon, value, attempt, gender, code, last) plus new, the replacement of each, and made, the canonical form of that.

    Letters and digits depend on kind, canonical form and attempt only.  gender and code:
    what the entity's mentions together say, for those that don't say it themselves;
    last: the surrogate of a name's last word, which names share.
    """
    kind, canon, value, s, wider, base, other = map(F.col, ("kind", "canon", "value", "__s", "__wider", "__base", "__other"))
    by = lambda **x: F.coalesce(*[F.when(kind == k, c) for k, c in x.items()])
    more = lambda c, what, n: F.concat(c, F.repeat(F.lit(what), n))
    title = F.regexp_extract(value, rf"^(?:{_TITLE})\.? ", 0)
    words = F.split(F.substr(value, F.length(title) + 1), " ")
    domain = F.regexp_extract(value, r"@(.*)$", 1)
    rows = forms.withColumns({"__s": _stream(p, kind, canon, F.col("attempt").cast("string")), "__wider": F.floor(F.col("attempt") / p.widen).cast("int")})
    # what is redrawn letter by letter, how much at its start stays, and what is redrawn apart from the entity
    shape = by(email=more(F.regexp_extract(value, r"^(.*)@", 1), "a", wider), phone=more(value, "0", F.greatest(F.lit(0), wider - 1)), surname=more(value, "a", wider), card=value, iban=value, ssn=value)
    code = F.coalesce(_code(value), F.col("code"), F.lit(0))
    keep = F.coalesce(by(phone=F.when(F.startswith(value, F.lit("+")) & (wider == 0), code + 1), iban=F.lit(2)), F.lit(0))
    part = by(email=F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1), name=F.array_join(F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0))), " "))
    rows = rows.withColumns({"__base": _shaped(shape, s, keep), "__other": _shaped(part, _stream(p, F.lit("part"), kind, F.lower(part)), F.lit(0))})

    octets = F.split(value, r"\.")
    private = F.when(F.startswith(value, F.lit("192.168.")), 2).when(F.element_at(octets, 1).isin("10", "127"), 1).otherwise(0) - wider
    octet = lambda i: F.pmod(_byte(s, i * 2) * 256 + _byte(s, i * 2 + 1), F.when(i == 0, 223).otherwise(254)) + 1
    ip = F.array_join(F.transform(octets, lambda x, i: F.when(i < private, x).otherwise(octet(i).cast("string"))), ".")
    digits = F.regexp_replace(base, r"\D", "")
    mend = F.pmod(F.substring(digits, -1, 1).cast("int") - _luhn(digits), F.lit(10)).cast("string")
    valid = F.pmod(_luhn(F.regexp_replace(value, r"\D", "")), F.lit(10)) == 0
    card = F.when(valid, F.concat(F.substr(base, F.lit(1), F.length(base) - 1), mend)).otherwise(base)
    country, bban = F.substr(base, F.lit(1), F.lit(2)), F.substr(base, F.lit(5))
    check = F.lpad((98 - _iban_rest(F.concat(country, F.lit("00"), F.regexp_replace(bban, " ", "")))).cast("string"), 2, "0")
    iban = F.when(_iban_rest(F.regexp_replace(value, " ", "")) == 1, F.concat(country, check, bban)).otherwise(base)

    script = F.when(F.regexp_like(canon, F.lit(r"\p{IsCyrillic}")), "Cyrillic").when(F.regexp_like(canon, F.lit(r"\p{IsGreek}")), "Greek").otherwise("Latin")
    # without a gendered title among the mentions the hash decides; of mentions with both each follows its own
    gender = F.coalesce(_gender(value), F.col("gender"), F.when(F.pmod(_byte(_stream(p, F.lit("gender"), canon), F.lit(0)), F.lit(2)) == 0, "male").otherwise("female"))
    names = F.element_at(F.create_map(*[F.lit(x) for group, known in GIVEN.items() for x in (group, " ".join(known))]), F.concat_ws(" ", gender, script))
    given = _bound(F.split(names, " "), lambda known: F.array_join(F.transform(F.sequence(F.lit(0), wider), lambda i: F.element_at(known, F.pmod(_byte(s, i), F.size(known)) + 1)), "-"))
    first = F.element_at(words, 1)
    given = F.when(first == F.upper(first), F.upper(given)).otherwise(given)
    name = F.concat(title, F.when(F.size(words) > 1, F.concat_ws(" ", given, F.when(other != "", other), F.col("last"))).otherwise(F.col("last")))
    email = F.concat(base, F.lit("@"), other, F.regexp_extract(domain, r"(\.[^.]*)$", 1))
    rows = rows.withColumn("new", F.coalesce(by(email=email, ip=ip, card=card, iban=iban, name=name), base)).drop("__s", "__wider", "__base", "__other")
    return rows.withColumn("made", canonical(kind, F.col("new")))


KEY = ["kind", "canon"]


def _distinct(forms: DataFrame, p: PiiParams) -> DataFrame:
    """forms (kind, canon, value, gender, code, last) with ``new``, so that no two entities of a kind share a surrogate's canonical form and none is an entity.

    All spellings of an entity are checked and move together.  Of entities with one
    surrogate the smallest keeps it; in each round only the others are drawn again.
    """
    now = written(drawn(forms.withColumn("attempt", F.lit(0)), p), "surrogates")
    real = written(now.select("kind", F.col("canon").alias("made"), F.lit(True).alias("real")).distinct(), "real")
    for _ in range(p.rounds):
        made = now.select(*KEY, "made").distinct()
        first = made.groupBy("kind", "made").agg(F.min("canon").alias("owner"), F.count("*").alias("n")).join(real, ["kind", "made"], "left")
        clash = first.where("n > 1 OR real").select("kind", "made", F.when(F.col("real"), F.lit(None).cast("string")).otherwise(F.col("owner")).alias("owner"))
        moved = written(made.join(clash, ["kind", "made"]).where(~F.col("canon").eqNullSafe(F.col("owner"))).select(*KEY).distinct(), "moved")
        if moved.isEmpty():
            discard(real, moved)
            return now
        again = drawn(now.join(moved, KEY, "left_semi").drop("new", "made").withColumn("attempt", F.col("attempt") + 1), p)
        now, before = written(now.join(moved, KEY, "left_anti").unionByName(again), "surrogates"), now
        discard(before, moved)
    raise ValueError(f"surrogates still collide after {p.rounds} rounds")


def surrogates(mentions: DataFrame, p: PiiParams) -> DataFrame:
    """(kind, canon, value, new) of the distinct mentions (kind, canon, value).

    Last words of names are resolved first and by themselves, so that all names that
    share one, and mentions of it alone, share its surrogate.
    """
    parts = int(mentions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    traits = mentions.groupBy(*KEY).agg(F.min(F.when(F.col("kind") == "name", _gender(F.col("value")))).alias("gender"), F.min(F.when(F.col("kind") == "phone", _code(F.col("value")))).alias("code"))
    # a number of partitions of its own: these rows are few bytes and much work
    forms = written(mentions.select(*KEY, "value").distinct().join(traits, KEY).withColumn("word", F.when(F.col("kind") == "name", _last(F.col("value")))).repartition(parts, *KEY), "forms")
    none = F.lit(None).cast("string")
    words = forms.where("word IS NOT NULL").select(F.lit("surname").alias("kind"), canonical(F.lit("surname"), F.col("word")).alias("canon"), F.col("word").alias("value"), none.alias("gender"), F.lit(None).cast("int").alias("code"), none.alias("last"))
    last = _distinct(words.distinct().repartition(parts, *KEY), p)
    forms = forms.join(last.select(F.col("value").alias("word"), F.col("new").alias("last")), "word", "left").drop("word")
    return _distinct(forms.repartition(parts, *KEY), p).select(*KEY, "value", "new")


def _pattern(found: Column) -> Column:
    """PATTERN, or the words of the names found as well, longest first."""
    title = rf"^(?:{_TITLE})\.? "
    names = F.transform(F.filter(found, lambda v: F.regexp_like(v, F.lit(title))), lambda v: F.regexp_replace(v, title, ""))
    known = F.array_sort(F.array_distinct(F.concat(names, F.transform(names, _last))), lambda a, b: F.length(b) - F.length(a))
    either = F.array_join(F.transform(known, lambda v: F.concat(F.lit("\\Q"), v, F.lit("\\E"))), "|")
    return F.when(F.size(names) > 0, F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), either, F.lit(r")(?![\p{L}\p{N}])"))).otherwise(F.lit(PATTERN))


def _found(text: Column) -> Column:
    return F.when(F.regexp_like(text, F.lit(HINT)), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def changed(docs: DataFrame, p: PiiParams) -> DataFrame:
    """docs' rows with an entity, text rewritten, plus __entities, the number of mentions replaced.

    Rows without an entity, null and empty texts don't occur.  Repeated rows each occur
    and are rewritten alike; rows that share a doc_id with other texts are rewritten each
    by its own mentions; a null doc_id is one like others.  Texts are read whole.  No
    rows: no rows.
    """
    text = F.col("text").cast("string")
    key = [F.col("doc_id").alias("__id"), F.xxhash64(text).alias("__digest")]
    rows = docs.select("*", *key, _found(text).alias("__found")).where("size(__found) > 0").withColumn("__pattern", _pattern(F.col("__found")))
    rows = written(rows.withColumn("__found", F.regexp_extract_all(text, F.col("__pattern"), F.lit(0))), "private")
    each = rows.select("__id", "__digest", F.posexplode("__found").alias("pos", "value")).distinct().withColumn("kind", _kind(F.col("value")))
    each = written(each.withColumn("canon", canonical(F.col("kind"), F.col("value"))), "mentions")
    new = each.join(surrogates(each, p), [*KEY, "value"]).select("__id", "__digest", "pos", "new")
    lists = new.groupBy("__id", "__digest").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x.new).alias("__new")).withColumnsRenamed({"__id": "__i", "__digest": "__d"})
    out = rows.join(lists, F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__digest") == F.col("__d")))
    pieces = F.zip_with(F.split(text, F.col("__pattern"), -1), F.col("__new"), lambda a, b: F.concat(a, F.coalesce(b, F.lit(""))))
    return out.withColumn("__entities", F.size("__found")).withColumn("text", F.array_join(pieces, "")).select(*docs.columns, "__entities")


def pseudonymised(docs: DataFrame, p: PiiParams) -> DataFrame:
    """All rows of docs, texts with entities rewritten as in changed(); null and empty texts stay as they are."""
    clean = F.size(_found(F.coalesce(F.col("text").cast("string"), F.lit("")))) == 0
    return docs.where(clean).unionByName(changed(docs, p).select(*docs.columns))


def digest(docs: DataFrame, p: PiiParams) -> DataFrame:
    """doc_id, n_entities and the rewritten text of the documents that have any."""
    return changed(docs.select("doc_id", "text"), p).select("doc_id", F.col("__entities").cast("long").alias("n_entities"), "text")
