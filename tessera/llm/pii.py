"""PII surrogate generation.

Detected entities (mail and network addresses, card, phone and other long numbers, account numbers, secrets, titled
names) are replaced by keyed surrogates of the same type and format: digits stay digits and letters keep their case
and script, separators and fixed parts stay where they are, card numbers keep a valid or invalid checksum, network
addresses keep octets in range, names are drawn for the title's gender and keep their script. Equal entities, compared
in normal form, get equal surrogates everywhere (coreference); different ones get different surrogates: collisions
among surrogates, and with entities of the corpus, are looked for over all kinds together, and the later entity is drawn
again. Every few draws the format widens by a letter, digit or syllable, so a format whose values are all in use still
ends; entities that find a free value in their own format never get there.

The patterns run over each text once, into a written table. Only documents with an entity take part in the joins, which
move entities and not texts; the texts of those documents shuffle once, the others pass straight through.

Defined results: null text stays null; texts without an entity are unchanged; overlapping kinds are decided in the
order of KINDS, leftmost first; repeated rows come back once each with equal surrogates; an empty table gives an
empty result; extra columns are carried by pseudonymise(), whose internal names start with an underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import materialize, release, salted_lookup, salts, table

#: Draws after which a format gets one more letter, digit or syllable.
WIDEN = 4
_MALE, _FEMALE = r"Mr|Mister|Herr|Monsieur|M(?=\.)|Señor|Sr|господин|г-н", r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа|г-жа"
_NAME = r"\p{Lu}[\p{L}'’-]+"
#: Kind and pattern, in the order in which they are tried at a place. No pattern has capturing groups.
KINDS = (
    ("mail", r"[\p{L}\p{N}][\p{L}\p{N}._%+-]*@(?:[\p{L}\p{N}-]+\.)+\p{L}{2,}"),
    ("secret", r"(?<![0-9A-Za-z])(?:AKIA[0-9A-Z]{16}|(?:sk|ghp|pk)[-_][0-9A-Za-z]{16,}|(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{32,})(?![0-9A-Za-z])"),
    ("account", r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    ("address", r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])"),
    ("card", r"(?<![0-9])(?:[0-9]{4}[ -]?){3}[0-9]{1,7}(?![0-9])"),
    ("phone", r"(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])|(?<![0-9-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9-])"),
    ("number", r"(?<![0-9-])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{9})(?![0-9-])"),
    ("man", rf"(?<!\p{{L}})(?:{_MALE})\.? {_NAME}(?: {_NAME})?"),
    ("woman", rf"(?<!\p{{L}})(?:{_FEMALE})\.? {_NAME}(?: {_NAME})?"),
)
PATTERN = "|".join(f"(?:{p})" for _, p in KINDS)
_TITLE = rf"^(?:{_MALE}|{_FEMALE})\.? "
#: Surrogate given names by gender, surname parts, in both scripts.
NAMES = {
    ("man", "latin"): "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Roman Simon Tomas Viktor".split(),
    ("woman", "latin"): "Alma Berta Clara Dora Elena Flora Greta Hanna Irene Julia Klara Laura Maria Nora Olga Paula Rosa Sara Tina Vera".split(),
    ("man", "cyrillic"): "Антон Борис Виктор Глеб Денис Егор Захар Иван Кирилл Лев Максим Никита Олег Павел Роман Семён Тимур Фёдор Юрий Яков".split(),
    ("woman", "cyrillic"): "Алина Белла Вера Галина Дарья Елена Зоя Инна Ксения Лидия Мария Нина Ольга Полина Раиса София Тамара Ульяна Юлия Яна".split(),
}
PARTS = {"latin": "bar bel bor dan del dor fal fen gar gol hal hen kar kol lan len mar mel nor pel ran sel tam vel".split(), "cyrillic": "бар бел бор дан дел дор фал фен гар гол хал хен кар кол лан лен мар мел нор пел ран сел там вел".split()}


def kind_of(value: Column) -> Column:
    return reduce(lambda rest, k: F.when(value.rlike(f"^(?:{k[1]})$"), k[0]).otherwise(rest), reversed(KINDS), F.lit("number"))


def normal_form(kind: Column, value: Column) -> Column:
    """What two mentions of one entity share: lower case for mail, no separators for numbers, no title for names."""
    return (
        F.when(kind == "mail", F.lower(value))
        .when(kind.isin("card", "phone", "number", "account"), F.regexp_replace(value, r"[^0-9A-Za-z]", ""))
        .when(kind.isin("man", "woman"), F.regexp_replace(value, _TITLE, ""))
        .otherwise(value)
    )


def _stream(key: str, seed: Column) -> Column:
    """256 keyed numbers from 0 to 255, as an array."""
    hexes = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(str(i)), seed), 512) for i in range(4)])
    return F.transform(F.regexp_extract_all(hexes, F.lit(".."), F.lit(0)), lambda x: F.conv(x, 16, 10).cast("int"))


def _letters(characters: Column, stream: str, first: Column) -> Column:
    """Each digit and letter by a keyed one of the same class, the n-th by the n-th number; all else stays."""

    def one(c: Column, i: Column) -> Column:
        n = F.get(stream, F.pmod(i + first, F.lit(256)))
        pick = lambda alphabet: F.substr(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))
        return (
            F.when(c.between("0", "9"), pick("0123456789"))
            .when(c.between("a", "z"), pick("abcdefghijklmnopqrstuvwxyz"))
            .when(c.between("A", "Z"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
            .when(c < "\x80", c)
            .when(c.rlike(r"^\p{IsCyrillic}$") & c.rlike(r"^\p{Ll}$"), pick("абвгдежзиклмнопрстуфхцчшэюя"))
            .when(c.rlike(r"^\p{IsCyrillic}$"), pick("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"))
            .when(c.rlike(r"^\p{IsGreek}$") & c.rlike(r"^\p{Ll}$"), pick("αβγδεζηθικλμνξοπρστυφχψω"))
            .when(c.rlike(r"^\p{IsGreek}$"), pick("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"))
            .when(c.rlike(r"^\p{Ll}$"), pick("abcdefghijklmnopqrstuvwxyzäöüéèñ"))
            .when(c.rlike(r"^\p{Lu}$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÉÈÑ"))
            .otherwise(c)
        )

    return F.array_join(F.transform(characters, one), "")


def _checksum(digits: Column) -> Column:
    """The Luhn sum of a string of digits, modulo 10."""

    def add(total: Column, x: Column) -> Column:
        return total + x

    values = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(c.cast("int")))
    return F.pmod(F.aggregate(F.filter(values, lambda v: v.isNotNull()), F.lit(0), add), F.lit(10))


def _draw(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, value in normal form, attempt) with their surrogate in normal form."""
    out = entities.withColumn("_stream", _stream(key, F.concat_ws("|", "kind", "value", F.col("attempt").cast("string"))))
    extra = F.floor(F.col("attempt") / WIDEN).cast("int")  # characters or syllables more than the entity has

    def more(alphabet: str) -> Column:
        one = lambda i: F.substr(F.lit(alphabet), F.pmod(F.get("_stream", F.pmod(i + 200, F.lit(256))), F.lit(len(alphabet))) + 1, F.lit(1))
        return F.when(extra > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(extra, F.lit(1))), one), "")).otherwise("")

    longer = more("0123456789")
    letters = _letters(F.split("value", ""), "_stream", F.lit(0))
    local = F.regexp_extract("value", r"^([^@]*)@", 1)
    domain = F.regexp_extract("value", r"@(.*)\.[^.]*$", 1)
    ending = F.regexp_extract("value", r"(\.[^.]*)$", 1)
    host = F.when(F.col("value").rlike(r"@(?:.*\.)?example\.(?:com|org|net)$"), domain).otherwise(_letters(F.split(domain, ""), "_stream", F.lit(80)))
    mail = F.concat(_letters(F.split(local, ""), "_stream", F.lit(0)), more("abcdefghijklmnopqrstuvwxyz"), F.lit("@"), host, ending)
    hexes = F.when(F.col("value").rlike("^[0-9a-f]+$"), "0123456789abcdef").when(F.col("value").rlike("^[0-9A-F]+$"), "0123456789ABCDEF")
    digit = lambda c, i: F.substr(hexes, F.pmod(F.get("_stream", F.pmod(i, F.lit(256))), F.lit(16)) + 1, F.lit(1))
    secret = F.concat(F.when(hexes.isNotNull(), F.array_join(F.transform(F.split("value", ""), digit), "")).otherwise(letters), longer)
    octet = lambda i: F.pmod(F.get("_stream", F.lit(i)), F.lit(254)) + 1
    address = F.concat_ws(".", *[octet(i).cast("string") for i in range(4)])
    phone = F.concat(F.substring("value", 1, 1), F.substr(letters, F.lit(2)), longer)
    body = F.concat(F.substring("value", 1, 1), F.substr(letters, F.lit(2), F.char_length("value") - 2), longer)
    # the last digit of a card brings its checksum to 0 where the entity's is 0, and off it otherwise
    need = F.pmod(F.lit(10) - _checksum(F.concat(body, F.lit("0"))), F.lit(10))
    card = F.concat(body, F.when(_checksum(F.col("value")) == 0, need).otherwise(F.pmod(need + 1 + F.pmod(F.get("_stream", F.lit(99)), F.lit(9)), F.lit(10))).cast("string"))
    account = F.concat(F.substring("value", 1, 2), F.substr(letters, F.lit(3)), longer)
    script = F.when(F.col("value").rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def name(kind: str, alphabet: str) -> Column:
        pick = lambda options, i: F.get(F.array(*map(F.lit, options)), F.pmod(F.get("_stream", F.lit(i)), F.lit(len(options))))
        part = lambda i: F.get(F.array(*map(F.lit, PARTS[alphabet])), F.pmod(F.get("_stream", F.pmod(i, F.lit(256))), F.lit(len(PARTS[alphabet]))))
        surname = F.initcap(F.array_join(F.transform(F.sequence(F.lit(1), extra + 3), part), ""))
        return F.when(F.col("value").contains(" "), F.concat_ws(" ", pick(NAMES[kind, alphabet], 0), surname)).otherwise(surname)

    named = reduce(lambda rest, k: F.when((F.col("kind") == k[0]) & (script == k[1]), name(*k)).otherwise(rest), NAMES, F.lit(None))
    chosen = F.when(F.col("kind") == "mail", mail).when(F.col("kind") == "address", address).when(F.col("kind") == "phone", phone).when(F.col("kind") == "card", card).when(F.col("kind") == "account", account).when(F.col("kind") == "secret", secret).when(F.col("kind").isin("man", "woman"), named).otherwise(F.concat(letters, longer))
    return out.withColumn("surrogate", chosen).drop("_stream")


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """entities (kind, value), distinct, with surrogates that differ from each other and from every entity.

    Each round keeps, of equal surrogates, the one of the lowest entity, unless an entity of the corpus or a kept
    surrogate has that value, and draws the rest again: only what collided goes on, so rounds shrink quickly. It ends,
    since formats widen. Draws are dealt over all tasks, small as the entities' files are.
    """
    spark = entities.sparkSession
    kept, left = None, materialize(entities.select("kind", "value", F.lit(0).alias("attempt")))
    values = entities.select(F.col("value").alias("surrogate"))
    while True:
        drawn = _draw(left.repartition(salts(spark), "kind", "value"), key)
        first = drawn.groupBy("surrogate").agg(F.min(F.struct("kind", "value")).alias("_of"))
        free = first.join(values, "surrogate", "left_anti")
        if kept is not None:
            free = free.join(kept.select("surrogate"), "surrogate", "left_anti")
        new = materialize(free.select("_of.kind", "_of.value", "surrogate"))
        kept = new if kept is None else kept.unionByName(new)
        rest = materialize(left.join(new.select("kind", "value"), ["kind", "value"], "left_anti").withColumn("attempt", F.col("attempt") + 1))
        release(spark, left)
        left = rest
        if left.isEmpty():
            return kept


def _put_into(value: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the mention's own format: separators, title and letter case of the mention are kept."""
    characters = F.split(value, "")
    plain = F.aggregate(
        characters,
        F.struct(F.lit("").alias("text"), F.lit(1).alias("next")),
        lambda s, c: F.when(c.between("0", "9") | c.between("A", "Z") | c.between("a", "z"), F.struct(F.concat(s["text"], F.substr(surrogate, s["next"], F.lit(1))).alias("text"), (s["next"] + 1).alias("next"))).otherwise(F.struct(F.concat(s["text"], c).alias("text"), s["next"].alias("next"))),
    )
    plain = F.concat(plain["text"], F.substr(surrogate, plain["next"]))  # what a widened surrogate has more
    title = F.regexp_extract(value, _TITLE, 0)
    mail = F.when(value == F.upper(value), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("card", "phone", "number", "account"), plain).when(kind.isin("man", "woman"), F.concat(title, surrogate)).when(kind == "mail", mail).otherwise(surrogate)


def pseudonymise(docs: DataFrame, key: str) -> DataFrame:
    """docs with surrogates in their texts, and n_replaced; surrogates depend on the secret key."""
    found = F.coalesce(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), F.array().cast("array<string>"))
    scanned = materialize(docs.withColumn("_found", found).withColumn("_row", F.monotonically_increasing_id()))
    without = scanned.filter(F.size("_found") == 0).select(*docs.columns, F.lit(0).cast("long").alias("n_replaced"))
    touched = scanned.filter(F.size("_found") > 0)
    mentions = touched.select("_row", F.explode(F.array_distinct("_found")).alias("_mention"))
    kind = kind_of(F.col("_mention"))
    mentions = materialize(mentions.repartition(salts(docs.sparkSession), "_row", "_mention").select("_row", "_mention", kind.alias("kind")).withColumn("value", normal_form(F.col("kind"), F.col("_mention"))))
    entities = materialize(mentions.select("kind", "value").distinct())
    drawn = surrogates(entities, key).withColumn("_entity", F.concat_ws("|", "kind", "value")).select("_entity", "surrogate")
    named = salted_lookup(mentions.withColumn("_entity", F.concat_ws("|", "kind", "value")), "_entity", drawn, F.col("_row"))
    pairs = named.select("_row", "_mention", _put_into(F.col("_mention"), F.col("kind"), F.col("surrogate")).alias("_new"))
    by_row = pairs.groupBy("_row").agg(F.map_from_entries(F.collect_list(F.struct("_mention", "_new"))).alias("_map"))
    joined = touched.join(by_row, "_row")
    replaced = F.zip_with(F.split("text", PATTERN), "_found", lambda gap, m: F.concat(gap, F.coalesce(F.element_at("_map", m), F.lit(""))))
    new = joined.withColumn("n_replaced", F.size("_found").cast("long")).withColumn("_text", F.array_join(replaced, ""))
    rest = [F.col(c) if c != "text" else F.col("_text").alias("text") for c in docs.columns]
    return without.unionByName(new.select(*rest, "n_replaced"))


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """The key is the setting spark.tessera.surrogate.key; the value below, known to everyone, hides nothing."""
    key = spark.conf.get("spark.tessera.surrogate.key", "for tests")
    return pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), key)
