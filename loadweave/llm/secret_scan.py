"""Secret scans: candidate strings judged by a random forest, in DataFrame operations alone.

A token (between white space) is cut into parts at quotes, brackets, assignment signs and other
separators; each part is a candidate of its own, with the key name before it, if it holds a run
of at least ``LEAST`` characters from the alphabets of keys with a digit or both letter cases, or
follows a word that announces a secret, begins as a provider's keys do or stands in a private key
in PEM form.  What follows the token's last assignment sign is one as
well, as a secret may hold separators.  A document-level pattern leaves documents without any at
once.  The forest (MLlib) removes false positives by the candidate's length, its transitions
between character classes, its coverage by dictionary words, signs of paths and the
neighbouring words.  It is trained on labelled findings: real-looking keys of known providers
and random strings in assignments against hashes in prose, paths, addresses, identifiers, dates,
numbers and placeholders, made from a fixed seed (``labelled_findings``); a table of own
findings of the same form may replace them.

Defined results: null and empty texts have no findings; every finding is a row, repeated
ones too; positions count tokens from 0.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, row_key, table

LEAST = 16
#: Characters of a value that the tokens before it announce.
TOLD = 6
THRESHOLD = 0.5
#: Words that announce a secret, beginnings of providers' keys, dictionary words.
ANNOUNCED = r"(?i)(secret|token|passw|pwd|api.?key|apikey|access.?key|private.?key|credential|auth|bearer)"
PROVIDERS = r"^(AKIA|ASIA|ghp_|gho_|ghs_|github_pat_|xox[abprs]-|sk-|sk_live_|rk_live_|AIza|eyJ|glpat-|npm_|SG\.|hf_)"
DICTIONARY = r"(?i)(home|users?|usr|var|lib|local|src|main|test|data|file|index|page|image|http|https|www|com|org|net|html|example|sample|token|version|release|build|config|class|name|your|here|value|string|python|java|node|module|static|public|the|and|for|with|this|that)"
_RUN = r"[A-Za-z0-9+/_=\-.]"
_CORE = rf"{_RUN}{{{LEAST},}}"
#: Between the parts of a token; an assignment sign that pads a value's end is no separator.
_SEPARATORS = r"[\"'`,;&=:@?{}()\[\]<>|]+"
_PADDING = r"=(?==*+[\"'`]*+(?:$|[,;&:{}()\[\]<>|]))"
_PAD = "￾"
#: A user's password in an address.
_LOGIN = r"://[^/@\s]*:[^@\s]{6,}@"
#: Tokens with a long run (and what else it takes), as they stand between white space.
_LONG = [rf"(?=\S*[0-9])\S*?{_CORE}", rf"(?=\S*[a-z])(?=\S*[A-Z])\S*?{_CORE}", rf"(?=\S*?{PROVIDERS[1:]})\S*?{_CORE}"]
#: What a part with a long run needs besides.
PART_LONG = f"(token rlike '[0-9]' or (x.part rlike '[a-z]' and x.part rlike '[A-Z]') or x.core rlike r'{PROVIDERS}')"
#: What stands between the lines of a private key in PEM form.
_PEM = r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END|$)"
#: Documents without any of these hold no candidate.
_MAYBE = "|".join([rf"(?<!\S){long}" for long in _LONG] + [_LOGIN, rf"(?:{ANNOUNCED}\S*\s*[:=])", "PRIVATE KEY"])
FEATURES = ["length", "digits", "uppers", "transitions", "distinct", "coverage", "slashes", "dots", "dashes", "hex", "uuid", "provider", "announced", "assigned", "quoted", "placeholder", "in_path"]


def candidates(docs: DataFrame, id_type: str = "long") -> DataFrame:
    """doc_id, position, token (the key name and the part, for one of several parts), core and the two tokens before it."""
    docs = columns(docs, doc_id=id_type, text="string").where(F.col("text").rlike(_MAYBE))
    pem = F.split(F.array_join(F.regexp_extract_all("text", F.lit(_PEM), F.lit(1)), " "), r"\s+")
    tokens = docs.select("doc_id", F.split(F.col("text"), r"[\s]+").alias("t"), F.array_remove(pem, "").alias("pem"))
    told = f"""(length(x) >= {TOLD} and ((i > 1 and t[i - 1] rlike '^[:=]+$' and t[i - 2] rlike r'{ANNOUNCED}')
        or (i > 0 and t[i - 1] rlike r'{ANNOUNCED}[^ ]*[:=]+$')))"""
    long = " or ".join(f"x rlike r'^{p}'" for p in _LONG)
    # The private keys are bound once for a row; as a column they might be sought again for each token.
    picked = F.expr(f"""transform(array(pem), p -> filter(transform(t, (x, i) -> struct(i as position, x as token, {told} as told, array_contains(p, x) as pem, ({long}) as long,
        x rlike r'{ANNOUNCED}[^ ]*[:=][^ ]{{6,}}' as named)), c -> c.told or c.pem or c.long or c.named or c.token rlike r'{_LOGIN}'))[0]""")
    rows = tokens.select("doc_id", "t", picked.alias("picked"))
    before = "if(c.pem, 'PRIVATE KEY:', array_join(slice(t, greatest(c.position - 1, 1), least(c.position, 2)), ' ')) as before"
    rows = rows.select("doc_id", F.explode(F.expr(f"transform(picked, c -> struct(c.position, c.token, c.told or c.pem as told, c.long, c.named, {before}))")).alias("c"))
    return _parts(rows.select("doc_id", "c.*")).select("doc_id", F.col("position").cast("long").alias("position"), "token", "before", "core")


def _parts(tokens: DataFrame) -> DataFrame:
    """A row for each candidate in a token: its parts between separators, and what follows the last assignment sign if that is no part."""
    marked = F.regexp_replace("token", _PADDING, _PAD)
    held = tokens.withColumns({"parts": F.split(marked, _SEPARATORS), "seps": F.regexp_extract_all(marked, F.lit(_SEPARATORS), F.lit(0))})
    held = held.withColumn("parts", F.transform("parts", lambda x: F.replace(x, F.lit(_PAD), F.lit("="))))
    held = held.withColumn("parts", F.expr(r"""transform(parts, (x, i) -> struct(x as part, if(i > 0, seps[i - 1], '') as left, coalesce(get(seps, i), '') as right,
        if(i > 0 and seps[i - 1] rlike '[=:]', parts[i - 1], '') as key))"""))
    held = held.withColumn("parts", F.expr(r"""transform(parts, x -> struct(x.part, x.left, x.right,
        if(x.left = ':' and x.right like '@%' and x.key like '//%', 'password', regexp_replace(x.key, '^[^A-Za-z_]+', '')) as key))"""))
    single = F.expr("size(filter(parts, x -> x.part <> '')) = 1")
    # As an assignment of its own: name, sign, the quotes and the value.
    spelt = F.transform(
        "parts",
        lambda x: F.struct(
            F.when(single, F.col("token")).otherwise(
                F.concat(
                    F.when(x["left"].contains("@"), "@").otherwise(""),
                    F.when(x["key"] != "", F.concat(x["key"], F.regexp_extract(x["left"], "[=:]", 0))).otherwise(""),
                    F.regexp_extract(x["left"], "[\"'`]$", 0), x["part"], F.regexp_extract(x["right"], "^[\"'`]", 0),
                    F.when(x["right"].startswith("@") & (x["key"] != "password"), "@").otherwise(""),
                )
            ).alias("token"),
            _trimmed(x["part"]).alias("core"), x["part"].alias("part"), x["key"].alias("key"),
        ),
    )
    held = held.withColumn("parts", spelt).withColumn("rest", _core(F.col("token")))
    parts = F.expr(f"""filter(parts, x -> length(x.core) >= 6 and (told or x.key rlike r'{ANNOUNCED}' or (long and x.part rlike r'{_CORE}' and {PART_LONG})))""")
    rest = F.expr("if((told or long or named) and not exists(parts, x -> x.core = rest), array(struct(token, rest as core)), array())")
    both = F.concat(F.transform(parts, lambda x: F.struct(x["token"].alias("token"), x["core"].alias("core"))), rest)
    return held.select("doc_id", "position", "before", F.explode(both).alias("p")).select("doc_id", "position", "before", "p.token", "p.core")


def _core(token: Column) -> Column:
    """What follows the last assignment sign of a token, whatever separators stand in it, without quotes and outer punctuation."""
    return _trimmed(F.regexp_replace(token, r"^.*[=:][\"']?(?=[^\"'=:]{6})", ""))


def _trimmed(part: Column) -> Column:
    return F.regexp_replace(part, r"^[^A-Za-z0-9]+|[^A-Za-z0-9=]+$", "")


def measured(found: DataFrame) -> DataFrame:
    """The forest's features of candidates (token, core, before)."""
    core, size = F.col("core"), F.greatest(F.length("core"), F.lit(1))
    share = lambda pattern: F.length(F.regexp_replace(core, pattern, "")) / size
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("double")
    return found.withColumns(
        {
            "length": F.length("core").cast("double"),
            "digits": 1 - share("[0-9]"),
            "uppers": 1 - share("[A-Z]"),
            "transitions": F.regexp_count(core, F.lit("(?=[a-z][0-9A-Z])|(?=[A-Z][0-9a-z])|(?=[0-9][A-Za-z])")) / size,
            "distinct": F.size(F.array_distinct(F.split(core, ""))) / F.least(size, F.lit(40)),
            "coverage": 1 - share(DICTIONARY),
            "slashes": 1 - share("/"),
            "dots": 1 - share(r"\."),
            "dashes": 1 - share("[-_]"),
            "hex": flag(core.rlike("^[0-9a-f]+$|^[0-9A-F]+$")),
            "uuid": flag(core.rlike("(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")),
            "provider": flag(core.rlike(PROVIDERS)),
            "announced": flag(F.col("before").rlike(ANNOUNCED) | F.regexp_replace(F.col("token"), r"[=:].*$", "").rlike(ANNOUNCED)),
            "assigned": flag(F.col("before").rlike(r"[:=]\s*$") | F.col("token").rlike(r"^[A-Za-z_]+[:=]")),
            "quoted": flag(F.col("token").rlike(r"[\"'`]")),
            "placeholder": flag(core.rlike(r"(?i)example|xxxx|placeholder|changeme|your|dummy|0000000|1234567|(.)\1{5}")),
            "in_path": flag(F.col("token").rlike(r"^(/|\./|[a-z]+://|www\.)|\.[a-z]{2,4}$|@")),
        }
    )


def labelled_findings(spark: SparkSession, rows: int = 4000, first: int = 0) -> DataFrame:
    """Findings with their label (1: a secret), from hashes of their number; both labels alternate."""
    base = spark.range(first, first + rows, 1, 2).selectExpr(
        "id", "sha2(cast(id as string), 256) as h", "sha2(concat('b', id), 256) as g", "translate(base64(unhex(sha2(concat('c', id), 512))), '=', '') as k",
        "id % 2 as label", "cast(id / 2 as int) % 10 as kind", "element_at(array('token', 'secret', 'password', 'api_key', 'access_key', 'auth_token', 'API_SECRET'), cast(id / 20 as int) % 7 + 1) as name",
    )
    letters = "upper(translate(substr(k, 1, {n}), '+/', 'QZ'))"
    plain = "translate(substr(k, {at}, {n}), '+/', 'Ab')"
    secret = f"""case kind when 0 then concat('AKIA', {letters.format(n=16)}) when 1 then concat('"', substr(h, 1, 40), '"') when 2 then concat('ghp_', {plain.format(at=3, n=36)})
        when 3 then concat('"', {plain.format(at=1, n=32)}, '"') when 4 then concat('AKIA', {letters.format(n=16)}) when 5 then concat('sk_live_', {plain.format(at=5, n=24)})
        when 6 then concat(name, '="', substr(k, 1, 40), '"') when 7 then concat("'", substr(h, 1, 32), "'") when 8 then substr(k, 2, 64) else concat('xoxb-', substr(translate(h, 'abcdef', '123456'), 1, 12), '-', {plain.format(at=9, n=24)}) end"""
    harmless = """case kind when 0 then concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) when 1 then substr(h, 1, 40)
        when 2 then concat('/usr/local/lib/python3/', substr(h, 1, 6), '/module_', id, '.py') when 3 then concat('https://www.example.com/page/', id, '/', substr(g, 1, 8))
        when 4 then concat(translate(substr(h, 1, 12), '0123456789', 'aeioustnrl'), '_', translate(substr(g, 1, 8), '0123456789', 'mnpqrstuvw'), '_', id % 100) when 5 then concat('2024-', 1 + id % 12, '-', 1 + id % 28, 'T12:30:', 10 + id % 50, '.000Z')
        when 6 then translate(concat(h, g), 'abcdef', '123456') when 7 then element_at(array('"xxxxxxxxxxxxxxxx1234"', '"your_api_key_goes_here_1"', 'EXAMPLEKEY1234567890', '"changeme12345678"', '0000000000000000a'), cast(id / 20 as int) % 5 + 1)
        when 8 then concat('user.', substr(g, 1, 6), '@mail-server.example.org') else concat('release-build-', id % 9, '.', id % 7, '.', id % 5, '-main-test-data') end"""
    before = """case when label = 1 then case when kind in (1, 3, 7, 8) then concat(name, ' =') when kind in (0, 2, 5) and id % 3 = 0 then concat(name, ':') when kind = 9 then 'bearer' else 'of the' end
        else case kind when 1 then element_at(array('commit hash', 'the digest', 'sha1 sum'), cast(id / 20 as int) % 3 + 1) when 7 then concat(name, ' =') when 0 then 'id =' when 6 then 'order number' else 'see the' end end"""
    made = base.selectExpr("cast(label as double) as label", f"case when label = 1 then {secret} else {harmless} end as token", f"{before} as before")
    return made.withColumn("core", _core(F.col("token")))


def forest(findings: DataFrame):
    """A random forest on labelled findings; training rows are a bounded parameter of the caller."""
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep")
    trees = RandomForestClassifier(featuresCol="features", labelCol="label", numTrees=40, maxDepth=8, seed=7, featureSubsetStrategy="sqrt", minInstancesPerNode=3)
    return Pipeline(stages=[assembler, trees]).fit(measured(findings))


def findings(docs: DataFrame, model=None, threshold: float = THRESHOLD, id_type: str = "long") -> DataFrame:
    """doc_id, position, core, score and is_secret of every candidate."""
    model = model or forest(labelled_findings(docs.sparkSession))
    judged = model.transform(measured(candidates(docs, id_type)))
    judged = judged.withColumn("score", vector_to_array("probability")[1])
    return judged.select("doc_id", "position", "core", F.length("core").cast("long").alias("core_length"), "score", (F.col("score") >= threshold).alias("is_secret"))


def redacted(docs: DataFrame, model=None, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by a mark; all columns and rows stay."""
    found = findings(docs.select(row_key().alias("doc_id"), "text").where("doc_id is not null"), model, id_type="string").where("is_secret and length(core) > 0")
    found = found.groupBy(F.col("doc_id").alias("__row_key")).agg(F.array_sort(F.collect_set("core"), lambda x, y: F.length(y) - F.length(x)).alias("__cores"))
    text = F.aggregate("__cores", F.col("text"), lambda held, core: F.replace(held, core, F.lit(mark)))
    out = docs.withColumn("__row_key", row_key()).join(found, "__row_key", "left")
    return out.withColumn("text", F.when(F.col("__cores").isNull(), F.col("text")).otherwise(text)).select(*docs.columns)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings with a digest in place of the secret itself."""
    found = findings(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "position", "core_length", F.sha2("core", 256).alias("core_sha256"), "score", "is_secret")
