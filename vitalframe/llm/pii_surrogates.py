"""PII surrogates: detected entities get keyed, type-consistent replacements.

One pattern finds e-mail addresses, IPv4 addresses, phone, card, social security
and IBAN numbers, labelled or well-known secrets, and names behind a form of
address. An entity's normal form (digits of a number, lower case otherwise; each
part of a name by itself) and the key decide its surrogate, so all mentions,
however written, stay the same person or number. Surrogates keep type and format:
digits stay digits and letters letters of their script, punctuation, length,
country codes, top-level domains and a valid check digit of a card stay, octets
stay octets, given names keep the gender of the form of address. Letters of other
scripts than Latin, Cyrillic and Greek become Latin ones; a secret of signs alone
becomes letters.

Collision checks run on the distributed table of distinct entities: where two
entities of a type would get one surrogate, or a surrogate is itself an entity
of the table, all but one try again with the next attempt number, until no
collision is left. So distinct entities stay distinct. Made-up names get a syllable
more with every attempt, and after ``GROW_AFTER`` attempts e-mail addresses, phone
numbers and secrets a character more, so short formats never run out.

Only DataFrame functions are used. Only texts with an entity are shuffled.

Defined cases: null and empty texts and texts without an entity stay as they
are; repeated rows and copies get equal texts; texts of any length are searched
whole; other columns are kept, whatever their names. Only IPv4
addresses, card, social security and IBAN numbers have formats of fixed size (10^9
values at least); about half of all of one would have to occur before it raises
(``MAX_ATTEMPTS``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_names, keep, read_table

#: Attempts after which a format of fixed size is taken to have no free surrogate left.
MAX_ATTEMPTS = 64
#: Attempts after which a surrogate of a format without a fixed size grows, by a character an attempt up to MAX_GROWN.
GROW_AFTER, MAX_GROWN = 16, 16

#: Forms of address by the gender they tell.
MALE = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "г-н", "Κύριος"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Fräulein", "Madame", "Mme", "Mademoiselle", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Госпожа", "г-жа", "Κυρία"]
EITHER = ["Dr", "Prof", "Doctor", "Professor", "Доктор"]

#: Country calling codes of two digits; those in 1 and 7 have one, all others three.
TWO_DIGIT_CODES = "20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]"

_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
_ADDRESS = "(?:" + "|".join(MALE + FEMALE + EITHER) + ")"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_LABEL = r"""(?i:token|secret|password|passwd|api[_-]?key)"? {0,3}[=:] {0,3}["']"""
#: Every alternative begins with a class of characters, so most places of a text fail on one test.
PATTERNS = {
    "SECRET": rf"""(?=[tTsSpPaAg])(?:{_LABEL}[^"'\s]{{6,}}["']|\bAKIA[0-9A-Z]{{16}}\b|\bgh[pousr]_[A-Za-z0-9]{{36,}}|\bsk-[A-Za-z0-9_-]{{20,}})""",
    "IP": rf"(?=\d)(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "SSN": r"(?=\d)(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "IBAN": r"(?=[A-Z][A-Z]\d)\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "PHONE": r"(?=[+(\d])(?:(?<![\w+(])(?:\+?\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+.-])(?:\+?\d{1,3}[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}(?![\d-]|\.\d)|(?<![\w+])\+\d{1,3}(?:[ .-]\d)?(?:[ .-]?\d{2,4}){2,5}(?!\d))",
    "CARD": r"(?=\d)(?<![\w.-])\d(?:[ -]?\d){12,18}(?![\w-]|\.\d)",
    "NAME": rf"(?=[MSHDFPГгДΚ])(?<![\p{{L}}\p{{N}}]){_ADDRESS}\.? {_NAME}(?: {_NAME})?",
}
#: Looked for only in texts with an at sign, before the others.
#: A domain has at most 127 labels of 63 characters, as names have: the matcher's stack grows with a repeated group.
EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,126}\p{L}{2,63}"
_OTHERS = "|".join(f"(?:{p})" for p in PATTERNS.values())
_ALL = f"(?:{EMAIL})|{_OTHERS}"
PATTERNS["EMAIL"] = EMAIL


def pattern_for(text: Column) -> Column:
    return F.when(F.instr(text, "@") > 0, F.lit(_ALL)).otherwise(F.lit(_OTHERS))


def has_entity(text: Column) -> Column:
    """Whether a text holds an entity; cheap necessary conditions come first."""
    quoted = (F.instr(text, '"') > 0) | (F.instr(text, "'") > 0)
    may = ((F.instr(text, "@") > 0) | text.rlike(r"\d[\d ().-]{5,}\d|[A-Z]{2}\d{2}") | text.rlike(r"AKIA|gh[pousr]_|sk-") | (quoted & text.rlike(f"(?=[tTsSpPaA]){_LABEL}"))
           | text.rlike(rf"(?=[MSHDFPГгДΚ])(?<![\p{{L}}\p{{N}}]){_ADDRESS}\.? \p{{Lu}}"))
    return F.coalesce(may & F.when(F.instr(text, "@") > 0, text.rlike(_ALL)).otherwise(text.rlike(_OTHERS)), F.lit(False))


#: Syllables and endings of made-up names by script.
SYLLABLES = {"latin": ["ba", "bel", "cor", "da", "del", "fa", "gar", "hol", "jan", "ka", "lor", "ma", "mer", "na", "nor", "pel", "ra", "ros", "sa", "tal", "tor", "va", "ven", "wil", "zan"],
             "cyrillic": ["ба", "бел", "ва", "вер", "гор", "да", "дон", "жар", "зар", "ка", "кол", "ла", "лен", "ма", "мир", "на", "нор", "пет", "ра", "рос", "са", "тар", "тор", "фел", "хар"],
             "greek": ["βα", "βελ", "γα", "δα", "δελ", "ζα", "θα", "θεο", "κα", "κορ", "λα", "λεν", "μα", "μερ", "να", "νορ", "πα", "πετ", "ρα", "ροσ", "σα", "ταλ", "τορ", "φα", "χαρ"]}
ENDINGS = {("latin", "M"): ["o", "us", "ert", "in"], ("latin", "F"): ["a", "ia", "ine", "ette"], ("latin", "X"): ["i", "en", "is", "y"], ("latin", "S"): ["son", "mann", "ez", "ier", "ford", "berg"],
           ("cyrillic", "M"): ["ей", "ан", "ил", "ор"], ("cyrillic", "F"): ["а", "ия", "ина", "ана"], ("cyrillic", "X"): ["и", "ень", "е", "ю"], ("cyrillic", "S"): ["енко", "ских", "ич", "ко", "ян", "ук"],
           ("greek", "M"): ["ος", "ης", "ας", "ων"], ("greek", "F"): ["α", "η", "ια", "ω"], ("greek", "X"): ["ι", "ε", "υ", "ει"], ("greek", "S"): ["ου", "ιδης", "ακης", "οπουλος", "ατος", "ελης"]}
#: Syllables of a name at the first attempt; every other attempt has one more, up to the most.
SYLLABLES_IN_NAME, MAX_SYLLABLES = 3, 10


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, r"\D", "")


def kind_of(entity: Column) -> Column:
    """The type of a whole match."""
    out = F.lit("SECRET")
    for kind in ("NAME", "CARD", "PHONE", "IBAN", "SSN", "IP", "EMAIL"):
        out = F.when(entity.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def atoms_of(entity: Column, kind: Column) -> Column:
    """A match of a type as an array of (kind, norm, piece); kind is null for pieces that stay."""
    atom = lambda k, n, p: F.struct(k.cast("string").alias("kind"), n.cast("string").alias("norm"), p.alias("piece"))
    # a labelled secret is its value between what stays
    label = F.regexp_extract(entity, f"^({_LABEL})", 1)
    value = F.when(label != "", F.substr(entity, F.length(label) + 1, F.length(entity) - F.length(label) - 1)).otherwise(entity)
    # a country code stays: the one a plus sign announces, else what stands before ten digits
    digits = _digits(entity)
    code = F.when(digits.rlike("^[17]"), 1).when(digits.rlike(f"^(?:{TWO_DIGIT_CODES})"), 2).otherwise(3)
    national = F.when(entity.contains("+"), F.substr(digits, code + 1, F.length(digits))).when(F.length(digits) > 10, F.substring(digits, -10, 10)).otherwise(digits)
    own = (F.when(kind == "PHONE", national).when(kind.isin("CARD", "SSN"), _digits(entity)).when(kind == "IBAN", F.regexp_replace(entity, " ", ""))
           .when(kind == "EMAIL", F.lower(entity)).otherwise(entity))
    address = F.regexp_extract(entity, rf"^({_ADDRESS}\.? )", 1)
    bare = F.regexp_replace(address, r"[. ]", "")
    gender = F.when(bare.isin(MALE), "M").when(bare.isin(FEMALE), "F").otherwise("X")
    parts = F.split(F.regexp_replace(entity, rf"^{_ADDRESS}\.? ", ""), " ")
    null = F.lit(None)
    given = atom(F.concat(F.lit("GIVEN_"), gender), F.lower(parts[0]), parts[0])
    surname = atom(F.lit("SURNAME"), F.lower(F.element_at(parts, -1)), F.element_at(parts, -1))
    name = F.when(F.size(parts) > 1, F.array(atom(null, null, address), given, atom(null, null, F.lit(" ")), surname)).otherwise(F.array(atom(null, null, address), surname))
    secret = F.array(atom(null, null, label), atom(F.lit("SECRET"), value, value), atom(null, null, F.when(label != "", F.substr(entity, F.length(entity), F.lit(1))).otherwise("")))
    return F.when(kind == "NAME", name).when(kind == "SECRET", secret).otherwise(F.array(atom(kind, own, entity)))


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hex digits that nobody without the key can foretell."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, norm, attempt.cast("string"), F.lit(key)), 512)


def _byte(stream: Column, i: Column) -> Column:
    """The i-th (from 0) byte of a stream, repeating after 64."""
    return F.conv(F.substr(stream, ((i % 64) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _map_characters(text: Column, stream: Column, digits: str = "0123456789") -> Column:
    """Every digit and letter replaced by one of its class and script; anything else stays."""
    pick = lambda chars, b: F.substr(F.lit(chars), (b % len(chars) + 1).cast("int"), F.lit(1))
    lower = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

    def one(c: Column, i: Column) -> Column:
        b = _byte(stream, i)
        return (F.when(c.rlike(r"^\d$"), pick(digits, b)).when(c.rlike(r"^\p{IsLatin}$") & (F.lower(c) == c), pick(lower["latin"], b)).when(c.rlike(r"^\p{IsLatin}$"), F.upper(pick(lower["latin"], b)))
                .when(c.rlike(r"^\p{IsCyrillic}$"), pick(lower["cyrillic"], b)).when(c.rlike(r"^\p{IsGreek}$"), pick(lower["greek"], b))
                .when(c.rlike(r"^\p{L}$"), pick(lower["latin"], b)).when(c.rlike(r"^\p{N}$"), pick(digits, b)).otherwise(c))

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _grown(stream: Column, attempt: Column, chars: str) -> Column:
    """What a surrogate of a late attempt has more."""
    more = F.array(*[F.substr(F.lit(chars), (_byte(stream, F.lit(40 + i)) % len(chars) + 1).cast("int"), F.lit(1)) for i in range(MAX_GROWN)])
    return F.when(attempt > GROW_AFTER, F.array_join(F.slice(more, 1, F.least(attempt - GROW_AFTER, F.lit(MAX_GROWN))), "")).otherwise("")


def _luhn(digits: Column) -> Column:
    """Luhn sum of a digit string."""
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return F.when((F.length(digits) - i) % 2 == 0, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), one), F.lit(0), lambda a, x: a + x)


def with_surrogate(rows: DataFrame, key: str) -> DataFrame:
    """Add ``surrogate`` to (kind, norm, attempt) rows; the keyed streams are columns, so they are computed once a row."""
    domain = F.substring_index("norm", "@", -1)
    streams = rows.withColumns({"_own": _stream(key, F.col("kind"), F.col("norm"), F.col("attempt")), "_domain": _stream(key, F.lit("DOMAIN"), domain, F.col("attempt"))})
    mapped = streams.withColumn("_mapped", _map_characters(F.col("norm"), F.col("_own")))
    return mapped.withColumn("surrogate", _surrogate(F.col("kind"), F.col("norm"), F.col("attempt"), F.col("_own"), F.col("_domain"), F.col("_mapped"))).drop("_own", "_domain", "_mapped")


def _surrogate(kind: Column, norm: Column, attempt: Column, s: Column, domain_stream: Column, mapped: Column) -> Column:
    """The normal form's surrogate from its streams."""
    hexed = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.lower(F.hex(_byte(s, i) % 16))), "")
    lettered = F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.char(_byte(s, i) % 26 + 97)), "")
    secret = F.when(norm.rlike("^[0-9a-f]+$"), hexed).when(norm.rlike(r"[\p{L}\p{N}]"), mapped).otherwise(lettered)
    secret = F.concat(secret, _grown(s, attempt, "0123456789abcdef"))
    # a domain's labels are mapped by the domain alone; its last one stays
    domain = F.substring_index(norm, "@", -1)
    email = F.concat(_map_characters(F.substring_index(norm, "@", 1), s), _grown(s, attempt, "abcdefghijklmnopqrstuvwxyz"), F.lit("@"), _map_characters(F.regexp_replace(domain, r"\.[^.]+$", ""), domain_stream), F.lit("."), F.substring_index(domain, ".", -1))
    ip = F.concat_ws(".", (_byte(s, F.lit(0)) % 223 + 1).cast("string"), *[_byte(s, F.lit(i)).cast("string") for i in (1, 2, 3)])
    # first digit (the brand) stays; a valid check digit stays valid
    card = F.concat(F.substring(norm, 1, 1), F.substr(mapped, F.lit(2), F.length(norm)))
    body = F.substr(card, F.lit(1), F.length(norm) - 1)
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10)).cast("string")
    card = F.when(_luhn(norm) % 10 == 0, F.concat(body, check)).otherwise(card)
    phone = F.concat(mapped, _grown(s, attempt, "0123456789"))
    iban = F.concat(F.substring(norm, 1, 2), F.substr(mapped, F.lit(3), F.length(norm)))
    script = F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")

    places = F.sequence(F.lit(0), F.least(attempt + SYLLABLES_IN_NAME, F.lit(MAX_SYLLABLES)) - 1)

    def name(ending: str) -> Column:
        out = F.lit(None).cast("string")
        for sc, syllables in SYLLABLES.items():
            parts = F.transform(places, lambda i: F.element_at(F.array(*map(F.lit, syllables)), (_byte(s, i * 2) * 256 + _byte(s, i * 2 + 1)) % len(syllables) + 1))
            last = F.element_at(F.array(*map(F.lit, ENDINGS[sc, ending])), _byte(s, F.lit(20)) % len(ENDINGS[sc, ending]) + 1)
            out = F.when(script == sc, F.concat(F.array_join(parts, ""), last)).otherwise(out)
        return out

    out = mapped
    for k, v in {"SECRET": secret, "EMAIL": email, "PHONE": phone, "IP": ip, "CARD": card, "IBAN": iban, "GIVEN_M": name("M"), "GIVEN_F": name("F"), "GIVEN_X": name("X"), "SURNAME": name("S")}.items():
        out = F.when(kind == k, v).otherwise(out)
    return out


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, surrogate) of distinct (kind, norm) rows: no two surrogates of a kind alike, none an entity itself."""
    tried = keep(with_surrogate(entities.select("kind", "norm", F.lit(0).alias("attempt")), key), "pii-try")
    # given names of all genders share one space, as do the kinds of their own
    space = F.when(F.col("kind").startswith("GIVEN"), "GIVEN").otherwise(F.col("kind"))
    # a made-up given name is not to be a real surname either, and the other way round
    spaces = F.when(F.col("kind").startswith("GIVEN") | (F.col("kind") == "SURNAME"), F.array(F.lit("GIVEN"), F.lit("SURNAME"))).otherwise(F.array(space))
    real = tried.select(F.explode(spaces).alias("space"), F.col("norm").alias("surrogate")).distinct()
    for attempt in range(1, MAX_ATTEMPTS + 1):
        spaced = tried.withColumn("space", space)
        # of those that share a surrogate the earliest assigned, then the least, keeps it
        owner = spaced.groupBy("space", "surrogate").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm", "kind")).alias("owner"))
        taken = owner.join(real.withColumn("is_real", F.lit(True)), ["space", "surrogate"], "left").where("n > 1 or is_real").select("space", "surrogate", "owner", "is_real")
        again = spaced.join(taken, ["space", "surrogate"]).where(F.coalesce("is_real", F.lit(False)) | (F.struct("attempt", "norm", "kind") != F.col("owner"))).select("kind", "norm")
        again = keep(again, "pii-again")
        if not again.limit(1).count():
            return tried.select("kind", "norm", "surrogate")
        moved = with_surrogate(again.withColumn("attempt", F.lit(attempt)), key)
        tried = keep(tried.join(again, ["kind", "norm"], "left_anti").unionByName(moved), "pii-try")
    raise ValueError(f"no free surrogates after {MAX_ATTEMPTS} attempts")


def _rendered(kind: Column, norm: Column, piece: Column, surrogate: Column) -> Column:
    """A surrogate in the layout of a mention."""
    # digit by digit from the end; digits beyond the surrogate (a country code) stay, those it has grown by follow
    chars = F.split(F.reverse(piece), "")
    flipped = F.reverse(F.substr(surrogate, F.lit(1), F.length(norm)))
    more = F.substr(surrogate, F.length(norm) + 1, F.length(surrogate))
    step = F.aggregate(chars, F.struct(F.lit(0).alias("n"), F.lit("").alias("out")), lambda a, c: F.struct(
        (a["n"] + F.when(c.rlike(r"^\d$"), 1).otherwise(0)).alias("n"),
        F.concat(a["out"], F.when(c.rlike(r"^\d$") & (a["n"] < F.length(flipped)), F.substr(flipped, a["n"] + 1, F.lit(1))).otherwise(c)).alias("out")), lambda a: F.reverse(a["out"]))
    grouped = F.when(piece.contains(" "), F.regexp_replace(surrogate, r"(.{4})(?=.)", "$1 ")).otherwise(surrogate)
    name = F.when(F.upper(piece) == piece, F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return F.when(kind.isin("PHONE", "CARD", "SSN"), F.concat(step, more)).when(kind == "IBAN", grouped).when(kind.startswith("GIVEN") | (kind == "SURNAME"), name).otherwise(surrogate)


def replace_entities(df: DataFrame, text: str, key: str, out: tuple[str, str] = ("_n_entities", "_kinds")) -> DataFrame:
    """``df`` with surrogates in its ``text``; adds the number of entities and their sorted distinct types, under the names ``out``.

    ``df`` must not have columns of these two names; any other names are fine.
    """
    if clash := {c.lower() for c in df.columns} & {c.lower() for c in out}:
        raise ValueError(f"the table has columns {sorted(clash)}")
    row_key, parts, aliases = free_names([*df.columns, *out], "row_key", "parts", "aliases")
    body, md5 = F.col(text), F.md5(F.col(text))
    pattern = pattern_for(body)
    found = F.regexp_extract_all(body, pattern, F.lit(0))
    has = has_entity(body)
    # one row a distinct text and atom
    some = df.where(has).select(md5.alias("_key"), F.posexplode(found).alias("_at", "_entity"))
    # the type is a column of its own, so its tests run once a match
    some = some.withColumn("_type", kind_of(F.col("_entity")))
    atoms = some.select("_key", "_at", F.posexplode(atoms_of(F.col("_entity"), F.col("_type"))).alias("_k", "_atom"))
    atoms = keep(atoms.select("_key", "_at", "_k", "_atom.kind", "_atom.norm", "_atom.piece").groupBy("_key", "_at", "_k").agg(F.first("kind").alias("kind"), F.first("norm").alias("norm"), F.first("piece").alias("piece")), "pii-atoms")
    table = assign(atoms.where("kind is not null").select("kind", "norm").distinct(), key)
    filled = atoms.join(table, ["kind", "norm"], "left").withColumn("new", F.when(F.col("kind").isNull(), F.col("piece")).otherwise(_rendered(F.col("kind"), F.col("norm"), F.col("piece"), F.col("surrogate"))))
    is_name = F.col("kind").startswith("GIVEN") | (F.col("kind") == "SURNAME")
    alias = F.struct(F.col("piece").alias("from"), F.col("new").alias("to"))
    by_text = filled.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("_at", "_k", "new", "kind"))).alias(parts), F.collect_set(F.when(is_name, alias)).alias(aliases)).withColumnRenamed("_key", row_key)
    marked = df.where(has).withColumn(row_key, md5).join(by_text, row_key)
    # gaps and matches alternate
    gaps = F.split(body, pattern, -1)
    entity = lambda at: F.array_join(F.transform(F.filter(parts, lambda a: a["_at"] == at), lambda a: a["new"]), "")
    joined = F.array_join(F.transform(gaps, lambda g, i: F.when(i == 0, g).otherwise(F.concat(entity(i - 1), g))), "")
    # other mentions of the text's names, without a form of address
    named = F.aggregate(F.array_sort(aliases), joined, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), p["from"], F.lit(r"(?![\p{L}\p{N}])")), p["to"]))
    kinds = F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda a: F.when(a["kind"].startswith("GIVEN") | (a["kind"] == "SURNAME"), F.lit("NAME")).otherwise(a["kind"])), lambda k: k.isNotNull())))
    n = (F.size(gaps) - 1).cast("long")
    changed = marked.select(*[(F.when(F.size(aliases) > 0, named).otherwise(joined)).alias(c) if c == text else F.col(c) for c in df.columns], n.alias(out[0]), kinds.alias(out[1]))
    same = df.where(~has).select(*df.columns, F.lit(0).cast("long").alias(out[0]), F.array().cast("array<string>").alias(out[1]))
    return same.unionByName(changed)


#: Key of the registered query; a user passes a secret of their own.
QUERY_KEY = "documents-surrogates"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates in place of detected entities."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    out = replace_entities(docs, "text", QUERY_KEY)
    return out.select("doc_id", "text", F.col("_n_entities").alias("n_entities"), F.col("_kinds").alias("kinds"))


def replaced(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with surrogates in their text; ``n_chars`` follows a changed text."""
    found = free_names(docs.columns, "n_entities", "kinds")
    out = replace_entities(docs, "text", QUERY_KEY, tuple(found))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(found[0]) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)
