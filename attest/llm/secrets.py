"""Secret scans with a random forest that removes false positives, in DataFrame functions only.

Candidates are found with one pattern, features of each candidate and its surroundings are column expressions, and a
random forest trained from labelled findings scores them. Nothing is shuffled for a scan: a document becomes its
candidates inside its task.
"""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attest.llm.common import row_of, stored, unfolded

# Names that announce a secret, public formats of credentials, and what a long mixed token looks like.
NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth[_-]?key|credential"
FORMATS = (r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[baprs]-[0-9A-Za-z-]{10,}"
           r"|sk_(?:live|test)_[0-9A-Za-z]{16,}|AIza[0-9A-Za-z_-]{30,}|eyJ[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{8,}\.[0-9A-Za-z_-]{4,}")
PEM = r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]*PRIVATE KEY-----)?"
# A name may stand anywhere in a word of these characters (DB_PASSWORD, userPassword, token_v2). The look ahead at the sign
# comes first, so that a word is searched for names once, however long it is.
PART = "[A-Za-z0-9_.-]"
SIGN = r"[\"']?\s{0,3}[:=]\s{0,3}[\"']?"
NAMED = rf"(?={PART}*+{SIGN}){PART}*?(?i:{NAMES}){PART}*+{SIGN}"
ANNOUNCED = rf"(?={PART}*+{SIGN}[^\s\"']{{6}}){NAMED}"
ASSIGNED = rf"(?<!{PART}){ANNOUNCED}(?:{PEM}|[^\s\"']{{6,}})"
# 12 characters with a digit among them, or 16 of any kind but signs alone; a token ends where an announced value begins.
MIXED = (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9]|(?=[+/_=-]*[A-Za-z])[A-Za-z+/_=-]{16})"
         rf"(?:[A-Za-z0-9_-]|[+/=](?!{ANNOUNCED})){{12,}}+")
CANDIDATE = f"{PEM}|\\b(?:{FORMATS})|{ASSIGNED}|{MIXED}"

# Common words of prose and of code, and words that stand beside numbers which are no secrets.
WORDS = ("about|after|and|are|blue|case|data|date|default|demo|dummy|example|false|file|for|from|green|have|hello|here|home|"
         "house|image|index|item|large|main|name|none|null|order|page|part|path|place|public|read|sample|small|some|temp|"
         "test|that|the|this|time|true|under|user|value|version|water|welcome|when|with|word|work|world|write|xxxx|your")
PAIRS = "th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ou|ea|ch|de|le|qu|ei|ie|un|se"
SYLLABLES = ("sch|ein|ver|heit|lich|ung|pfau|en|un|der|be|ge|ment|tion|con|pre|able|ous|inter|ism|ant|ici|pour|ado|mente|los|"
             "ster|ing|ness|ful|keit|zu|land|berg|wick|tra")
# Names with parts around them, and what people take for passwords.
FULL_NAMES = ("DB_PASSWORD|db_password|client_secret|userPassword|github_token|app.api-key|AWS_SECRET_ACCESS_KEY|smtp_pwd|"
              "authToken|ADMIN_PASSWD|x-auth-key|token_v2|service_credential|password2")
PASSES = ("hunter|dragon|monkey|purple|silver|shadow|summer|winter|falcon|tiger|rocket|guitar|cookie|banana|ginger|pepper|"
          "matrix|merlin|h4ck|p@ss|s3cr3t|w0rd9|qw3rty|l3tm3in|zxcvb|adm1n")
HARMLESS = (r"(?i)\b(?:commit|checksum|sha1|sha256|md5|digest|revision|etag|uuid|guid|isbn|issn|doi|phone|tel|fax|order|"
            r"invoice|tracking|version|build|example|sample|dummy|placeholder)\b")

MARK = "\x01"
FEATURES = ["length", "kinds", "distinct", "digits", "upper", "signs", "pairs", "words", "hex", "run", "assigned", "format",
            "path", "harmless", "marks"]
TREES, DEPTH, SEED = 24, 6, 7
AROUND = 60


def _share(part: Column, whole: Column) -> Column:
    return part.cast("double") / F.greatest(whole, F.lit(1))


def _without(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, F.lit(pattern), F.lit("")))


def features(rows: DataFrame) -> DataFrame:
    """Feature columns from before, found and after: what stands left of a candidate, the candidate, what follows."""
    name = rf"^\s*{NAMED}"
    value = F.regexp_replace("found", F.lit(name), F.lit(""))
    rows = rows.withColumn("value", F.when(F.length(value) > 0, value).otherwise(F.col("found")))
    v, n = F.col("value"), F.length("value")
    return rows.withColumns({
        "length": n.cast("double"),
        "kinds": _share(F.length(F.regexp_replace(v, F.lit("[a-z]+|[A-Z]+|[0-9]+|[^a-zA-Z0-9]+"), F.lit("x"))) - 1, n),
        "distinct": _share(F.size(F.array_distinct(F.split(v, ""))), n),
        "digits": _share(n - _without(v, "[0-9]"), n),
        "upper": _share(n - _without(v, "[A-Z]"), n),
        "signs": _share(n - _without(v, "[^A-Za-z0-9]"), n),
        "pairs": _share(n - _without(F.lower(v), PAIRS), n),
        "words": _share(n - _without(F.lower(v), WORDS), n),
        "hex": F.rlike(v, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$")).cast("double"),
        "run": _share(n - _without(v, r"(.)\1{2,}"), n),
        "assigned": (F.rlike("found", F.lit(name)) | F.rlike("before", F.lit(rf"(?i)(?:{NAMES}){PART}*[^\s]{{0,4}}\s*(?:is|[:=])?\s*[\"']?$"))).cast("double"),
        "format": F.rlike("found", F.lit(f"^(?:{FORMATS})$|-----BEGIN")).cast("double"),
        "path": F.greatest(F.rlike("before", F.lit(r"[/\\][^\s]*$|https?:[^\s]*$")).cast("double"),
                           F.rlike("found", F.lit(r"/[^/]+/")).cast("double"),
                           F.rlike("after", F.lit(r"^[/\\]|^\.[a-z]{2,4}\b")).cast("double")),
        "harmless": F.rlike(F.concat_ws(" ", "before", "found", "after"), F.lit(HARMLESS)).cast("double"),
        "marks": _share(n - _without(v, r"(?<=[A-Za-z0-9])[!@#$%^&*~?](?=[A-Za-z0-9!@#$%^&*~?])"), n),
    })


def default_findings(spark: SparkSession, per_form: int = 160) -> DataFrame:
    """(before, found, after, label): labelled findings in many forms, each filled with digests of its row number."""
    rows = spark.range(per_form).select(
        F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("h"), F.md5(F.col("id").cast("string")).alias("m"),
        F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256))).alias("b"))
    plain = F.regexp_replace("b", F.lit("[+/=]"), F.lit("x"))
    word = F.element_at(F.split(F.lit(WORDS), "\\|"), (F.col("id") % 60 + 1).cast("int"))
    other = F.element_at(F.split(F.lit(WORDS), "\\|"), (F.col("id") * 7 % 60 + 1).cast("int"))
    lead = F.concat(word, F.lit(" "), other, F.lit(" "))
    pick = lambda words, k: F.element_at(F.split(F.lit(words), "\\|"), (F.col("id") * k % (words.count("|") + 1) + 1).cast("int"))
    named = lambda sign: F.concat(pick(FULL_NAMES, 5), F.lit(sign))
    letters = F.translate("h", "0123456789", "ghijkmqstz")
    mixed = F.regexp_replace(F.concat("b", F.base64("m")), F.lit("[^A-Za-z]"), F.lit(""))
    sign = pick("!|@|#|$|%|&|*", 3)
    syllables = F.concat(*[pick(SYLLABLES, k) for k in (1, 5, 7, 11, 13, 17)])
    n = (F.col("id") % 24).cast("int")
    none = F.lit("")
    forms = [  # before, found, after, label
        (lead, F.concat(F.lit("password="), F.substring("m", 1, 18)), F.lit(" and"), 1),
        (lead, F.concat(F.lit("password: "), F.substr(plain, F.lit(1), n + 8)), none, 1),
        (lead, F.concat(F.lit('token = "'), F.substring("h", 1, 40)), F.lit('" then'), 1),
        (lead, F.concat(F.lit("api_key="), F.substr(plain, F.lit(2), n + 16)), F.lit("\n"), 1),
        (lead, F.concat(F.lit("secret: "), F.col("b")), none, 1),
        (lead, F.concat(F.lit("AKIA"), F.substring(F.upper(plain), 1, 16)), F.lit(" the"), 1),
        (lead, F.concat(F.lit("ghp_"), F.substring(plain, 1, 36)), none, 1),
        (lead, F.concat(F.lit("sk_live_"), F.substring(plain, 1, 24)), none, 1),
        (F.concat(lead, F.lit("the token is ")), F.substring("h", 1, 40), none, 1),
        (F.concat(lead, F.lit("export KEY ")), F.substring("b", 1, 40), none, 1),
        (lead, F.concat(F.lit("-----BEGIN PRIVATE KEY-----"), F.col("b"), F.lit("-----END PRIVATE KEY-----")), none, 1),
        (F.concat(lead, F.lit("commit ")), F.substring("h", 1, 40), F.lit(" by"), 0),
        (F.concat(lead, F.lit("sha256 ")), F.col("h"), none, 0),
        (F.concat(lead, F.lit("md5 checksum: ")), F.col("m"), none, 0),
        (F.concat(lead, F.lit("uuid ")), F.concat_ws("-", F.substring("m", 1, 8), F.substring("m", 9, 4),
                                                  F.substring("m", 13, 4), F.substring("m", 17, 4), F.substring("m", 21, 12)), none, 0),
        (F.concat(lead, F.lit("https://www.example.com/")), F.concat(word, F.lit("/"), other, F.lit("-"), F.col("id").cast("string"),
                                                                     F.lit("/page-2")), none, 0),
        (F.concat(lead, F.lit("/usr/")), F.concat(word, F.lit("/lib64/"), other, F.col("id").cast("string")), F.lit(".so"), 0),
        (F.concat(lead, F.lit("phone ")), F.concat(F.lit("555-0"), F.col("id").cast("string"), F.lit("-1"), (F.col("id") * 37).cast("string"),
                                                   F.lit("-88")), none, 0),
        (lead, F.concat(F.lit("2021-0"), (n % 9 + 1).cast("string"), F.lit("-1"), (n % 9).cast("string"), F.lit("-"), (F.col("id") + 1000).cast("string")), none, 0),
        (lead, F.concat(F.lit("password="), word, F.lit("_"), other), none, 0),
        (lead, F.concat(F.lit("password: "), F.lit("your_password_here")), none, 0),
        (lead, F.concat(F.lit("token = "), F.repeat(F.lit("x"), n + 8)), none, 0),
        (lead, F.concat(F.lit("secret: example_"), word), none, 0),
        (lead, F.concat(word, F.lit("_"), other, F.lit("_"), word, (F.col("id") % 100).cast("string")), none, 0),
        (lead, F.concat(F.lit("token: "), word, other), F.lit(" ring"), 0),
        (lead, F.concat(named("="), F.substring("m", 1, 18)), F.lit(" and"), 1),
        (lead, F.concat(named(": "), F.substr(plain, F.lit(1), n + 8)), none, 1),
        (lead, F.concat(named("="), F.substr(letters, F.lit(1), n + 10)), F.lit("\n"), 1),
        (lead, F.concat(named(' = "'), F.substr(letters, F.lit(3), n + 12)), F.lit('"'), 1),
        (lead, F.concat(named(" = '"), F.substr(mixed, F.lit(1), n + 10)), F.lit("'"), 1),
        (lead, F.concat(F.lit("token="), F.substr(letters, F.lit(5), n + 14)), none, 1),
        (lead, F.concat(named(": "), F.lit("abcdefghijklmnopqrstuvwxyz").substr(F.col("id").cast("int") % 8 + 1, n + 14)), none, 1),
        (lead, F.concat(named("="), pick(PASSES, 3), sign, pick(PASSES, 7)), none, 1),
        (lead, F.concat(named(": '"), pick(PASSES, 5), sign, pick(PASSES, 11), F.col("id").cast("string")), F.lit("'"), 1),
        (lead, F.concat(F.lit("password: "), pick(PASSES, 9), sign, F.substring("m", 1, 4)), none, 1),
        (lead, F.concat(named("="), F.substring("m", 1, 5), sign, F.substr(mixed, F.lit(1), n % 8 + 3), pick("#|!|.|@", 1), F.substring("h", 1, 3)), none, 1),
        (lead, F.substr(mixed, F.lit(1), n + 17), none, 1),
        (lead, F.concat(named("="), word, F.lit("_"), other), none, 0),
        (lead, F.concat(named(": "), word, other, F.lit(",")), F.lit(" ring"), 0),
        (lead, F.concat(named("="), F.lit("${"), F.upper(word), F.lit("_"), F.upper(other), F.lit("}")), none, 0),
        (lead, F.concat(named(" = "), word, F.lit("."), other, F.lit("("), word, F.lit(")")), none, 0),
        (lead, F.concat(named(": "), F.lit("<your-"), word, F.lit(">")), none, 0),
        (lead, F.concat(named("="), F.repeat(F.lit("*"), n + 6)), none, 0),
        (lead, F.concat(named(": "), syllables.substr(F.lit(1), n % 12 + 8)), F.lit(" "), 0),
        (lead, F.substr(F.regexp_replace("h", F.lit("[a-f]"), F.lit("")), F.lit(1), n % 12 + 12), F.lit(" "), 0),
        (lead, F.regexp_replace(F.substring(F.regexp_replace("h", F.lit("[a-f]"), F.lit("")), 1, 16), F.lit("(.{4})(?=.)"), F.lit("$1-")), none, 0),
        (lead, syllables, F.lit(" "), 0),
        (lead, F.concat(syllables, pick(WORDS, 13), syllables), F.lit(" "), 0),
        (lead, F.concat(F.initcap(F.reverse(syllables)), F.substring(syllables, 3, 9)), F.lit(", "), 0),
        (lead, F.concat(F.initcap(syllables), F.lit("-"), F.initcap(word), pick(SYLLABLES, 19)), F.lit(" "), 0),
        (lead, F.concat(named("="), F.lit("${"), F.upper(pick(FULL_NAMES, 3)), F.lit("}")), none, 0),
        (lead, F.concat(named("=$"), F.upper(pick(FULL_NAMES, 5))), none, 0),
        (lead, F.concat(word, other, pick(WORDS, 11), F.lit("ing")), F.lit(" "), 0),
        (lead, F.concat(word, F.lit("-"), other, F.lit("-"), pick(WORDS, 11), F.lit("-"), word), none, 0),
        (lead, F.concat(word, F.initcap(other), F.initcap(pick(WORDS, 11)), F.initcap(pick(SYLLABLES, 3))), F.lit("("), 0),
        (F.concat(lead, F.lit("/usr/")), F.concat(word, F.lit("/"), other, F.lit("/"), pick(SYLLABLES, 3), pick(WORDS, 11)), F.lit("."), 0),
        (lead, F.concat(F.initcap(word), F.repeat(F.lit("-"), n + 16)), F.lit("\n"), 0),
        (F.concat(lead, F.lit("order ")), F.lpad((F.col("id") * 7919).cast("string"), 14, "3"), none, 0),
    ]
    each = [F.struct(before.alias("before"), found.alias("found"), after.alias("after"), F.lit(float(label)).alias("label"))
            for before, found, after, label in forms]
    return rows.select(F.explode(F.array(*each)).alias("form")).select("form.*")


def fit(findings: DataFrame) -> PipelineModel:
    """A random forest from labelled findings (before, found, after, label 0 or 1); the same rows give the same forest."""
    ready = stored(features(findings).select(*FEATURES, "label").orderBy(*FEATURES, "label").coalesce(1), "findings")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featuresCol="__features", labelCol="label",
                                    probabilityCol="__probability", predictionCol="__prediction", rawPredictionCol="__raw")
    return Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="__features"), forest]).fit(ready)


def candidates(docs: DataFrame, columns: dict[str, Column], text: str = "text") -> DataFrame:
    """`columns`, and start, before, found, after of every candidate of every text (positions in characters, from 0)."""
    body = F.translate(F.col(f"`{text}`").cast("string"), MARK, " ")
    rows = docs.select(*[c.alias(n) for n, c in columns.items()], body.alias("__body")).where(F.rlike("__body", F.lit(CANDIDATE)))
    marked = F.split(F.regexp_replace("__body", F.lit(CANDIDATE), F.lit(f"{MARK}$0{MARK}")), MARK)
    rows = rows.withColumn("__pieces", marked)
    ends = F.aggregate("__pieces", F.array(F.lit(0)),
                       lambda held, piece: F.concat(held, F.array(F.element_at(held, -1) + F.length(piece))))
    rows = rows.withColumn("__starts", ends)
    each = F.transform(F.sequence(F.lit(1), F.size("__pieces") - 1, F.lit(2)), lambda k: F.struct(
        F.get("__starts", k).alias("start"), F.get("__pieces", k).alias("found")))
    rows = rows.withColumn("__each", F.explode(each))
    start, found = F.col("__each.start"), F.col("__each.found")
    low = F.greatest(start - AROUND, F.lit(0))
    return rows.select(
        *[F.col(f"`{n}`") for n in columns], start.alias("start"), found.alias("found"),
        F.substr("__body", low + 1, start - low).alias("before"),
        F.substr("__body", start + F.length(found) + 1, F.lit(AROUND)).alias("after"))


def scan(docs: DataFrame, columns: dict[str, Column], text: str = "text", findings: DataFrame | None = None,
         threshold: float = 0.5) -> DataFrame:
    """`columns`, and start, end, kind, value_sha256, score, is_secret of every candidate.

    start and end are characters of the text from 0, of the candidate without the name that announces it. Null and empty
    texts have no candidates, repeated rows are scanned as often as they occur, equal scores need no order, and an empty
    table gives no rows. `columns` are expressions over `docs` under any names but those of this result and of features.
    """
    spark = docs.sparkSession
    model = fit(default_findings(spark) if findings is None else findings)
    inner = {f"__c{k}": c for k, c in enumerate(columns.values())}
    scored = model.transform(features(candidates(docs, inner, text)))
    score = F.get(vector_to_array("__probability"), F.lit(1))
    at = F.col("start") + F.length("found") - F.length("value")
    kind = F.when(F.rlike("value", F.lit("^-----BEGIN")), "private key").when(F.col("format") == 1, "known format").when(
        F.rlike("found", F.lit(f"^{NAMED}")), "assigned").otherwise("token")
    return scored.select(*[F.col(i).alias(n) for i, n in zip(inner, columns)], at.alias("start"),
                         (F.col("start") + F.length("found")).alias("end"), kind.alias("kind"),
                         F.sha2("value", 256).alias("value_sha256"), score.alias("score"), (score >= threshold).alias("is_secret"))


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", **options) -> DataFrame:
    """`docs` with every secret in the text replaced by `mark`; texts without secrets and all other columns stay.

    Spans are gathered once per distinct text, so copies of one text, however many, share one short list. Other columns may
    have any names.
    """
    body = F.col(f"`{text}`").cast("string")
    found = scan(docs, {"text_key": F.xxhash64(body), "text_size": F.octet_length(body)}, text, **options).where("is_secret")
    spans = stored(found.select("text_key", "text_size", "start", "end").distinct().groupBy("text_key", "text_size").agg(
        F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__spans")), "secret-spans")
    spans = spans.withColumnRenamed("__spans", "spans")
    keyed = docs.select(row_of(docs).alias("row"), body.alias("body"), F.xxhash64(body).alias("text_key"), F.octet_length(body).alias("text_size"))
    joined = keyed.join(spans, ["text_key", "text_size"], "left")
    body = F.col("body")
    cut = F.aggregate("spans", F.struct(F.lit("").alias("done"), F.lit(0).alias("at")), lambda held, s: F.struct(
        F.concat(held["done"], F.substr(body, held["at"] + 1, s["start"] - held["at"]), F.lit(mark)).alias("done"),
        s["end"].alias("at")), lambda held: F.concat(held["done"], F.substr(body, held["at"] + 1, F.length(body))))
    return unfolded(joined, docs.columns, **{text: F.when(F.col("spans").isNull(), F.col("row").getField(text)).otherwise(cut)})
