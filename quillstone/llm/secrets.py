"""Secret scan with a random forest that removes false positives; DataFrame functions only.

Every run of twelve or more key characters in a text is a candidate, whatever stands
around it; a word may hold several. The forest looks at its length, how its characters
change from kind to kind, how much of it dictionary words cover, whether it is part of a
path and which words stand around it, and gives the chance that it is a secret.

It is trained from labelled findings: rows (value, key, before, after, path, secret), all of
which are learnt from; those of equal features are one row that weighs as many. No table of
such findings is supplied, so they come from two places: `labelled` takes the candidates of
all documents whose form or name leaves no doubt, and `examples` makes rows
by rule, from digests of row numbers, for forms that these documents may lack. If there are
more of the former, all of them together weigh as much as the latter. A table of own
findings may take their place. The dictionary is learnt from all documents too: the WORDS
words of four letters or more that most of them hold, and some fixed ones. Where the forest
may cut a feature, MLlib chooses by quantiles, of some ten thousand of the folded rows.

Defined results: null, empty and blank texts have no candidates; repeated words and
rows each give rows; rows with a null doc_id give rows with a null doc_id; findings
with a null value or label are not learnt from; with findings of one kind only, all
candidates get that kind; a score equal to the threshold is a secret; texts, words and
candidates of any length are read whole; an empty table gives an empty one. Only doc_id
and text are read, whatever other columns are called.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.common import cut

WORDS = 400
LEAST = 12  # characters of a candidate
#: A run of key characters; equals signs behind it belong to it unless they assign something.
VALUE = rf"[A-Za-z0-9+/_\-]{{{LEAST},}}+(?:={{1,2}}(?![A-Za-z0-9+/_\-\"'=]))?"
START, END = "\x01", "\x02"
#: Words that tell of a secret, and that tell of something else.
TELLING = "password|passwd|pwd|secret|token|apikey|api_key|api-key|auth|bearer|credential|private|access"
HARMLESS = "commit|sha|md5|checksum|digest|uuid|guid|id|order|invoice|version|revision|build|isbn|tracking|phone|card|account|hash|etag|ref"
DICTIONARY = (
    "the|and|for|with|from|that|this|data|file|name|user|test|image|page|list|item|value|index|report|final|draft|copy|backup|config|server|client|"
    "service|handler|manager|module|object|string|number|table|query|model|train|version|release|build|source|target|example|default|static|asset|"
    "content|upload|download|document|section|chapter|figure|january|february|march|april|june|july|august|september|october|november|december"
)
#: Forms that key issuers use.
KNOWN = "^(?:AKIA|ASIA)[0-9A-Z]{16}$|^gh[pousr]_|^xox[baprs]-|^sk_live_|^AIza"
FEATURES = (
    "length digits upper lower kinds changes digit_changes distinct hex only_digits covered vowels slashes path dashes telling harmless assigned quoted known"
).split()


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, word_at, value, key, before, after, path): one row per candidate."""
    word = F.filter(F.split(F.col("text"), r"\s+"), lambda w: w != "")

    def about(words: Column) -> Column:
        def row(w: Column, i: Column) -> Column:
            return F.struct(
                i.cast("int").alias("word_at"), w.alias("word"), F.coalesce(F.get(words, i - 2), F.lit("")).alias("before2"),
                F.coalesce(F.get(words, i - 1), F.lit("")).alias("before1"), F.coalesce(F.get(words, i + 1), F.lit("")).alias("after"),
            )

        return F.filter(F.transform(words, row), lambda x: F.length(x["word"]) >= LEAST)

    bound = F.get(F.transform(F.array(word), about), F.lit(0))
    rows = docs.filter(F.col("text").rlike(VALUE)).select("doc_id", F.explode(bound).alias("x")).select("doc_id", "x.*")
    # Parts that begin with a value each, the first one with what stands before; heads are the part before.
    parts = F.split(F.regexp_replace(F.translate("word", START + END, "  "), VALUE, f"{START}$0{END}"), START)
    rows = rows.filter(F.col("word").rlike(VALUE)).withColumn("parts", parts)
    each = F.transform(F.slice("parts", F.lit(2), F.size("parts") - 1), lambda x, i: F.struct(F.substring_index(x, END, 1).alias("value"), F.replace(F.get("parts", i), F.lit(END), F.lit("")).alias("path")))
    rows = rows.withColumn("part", F.explode(each)).withColumn("value", F.col("part.value"))
    head = F.col("part.path")
    # The name it is assigned to: in the word itself, or before an equals sign of its own.
    key = F.when(head.rlike("[=:]"), F.regexp_extract(head, r"([A-Za-z][A-Za-z_.\-]*)[\"']?[=:]+[\"']?$", 1)).when(F.col("before1").rlike(r"^[=:]+$"), F.col("before2"))
    key = key.when(F.col("before1").rlike(r"[=:]$"), F.regexp_replace("before1", r"[=:]+$", "")).otherwise("")
    rows = rows.withColumn("key", key).withColumn("path", head)
    return rows.select("doc_id", "word_at", "value", "key", F.col("before1").alias("before"), "after", "path")


def dictionary(docs: DataFrame, most: int = WORDS) -> str:
    """A pattern of the commonest words of the documents, the longest first, and of fixed ones."""
    words = docs.filter(F.col("doc_id").isNotNull()).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![a-z])[a-z]{4,12}(?![a-z])"), F.lit(0)))).alias("w"))
    found = words.groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 2").orderBy(F.desc("n"), "w").limit(most)
    return "|".join(sorted({*DICTIONARY.split("|"), *(r.w for r in found.collect())}, key=lambda w: (-len(w), w)))


def labelled(docs: DataFrame) -> DataFrame:
    """Findings of all documents that are told by their form or name; others are left out."""
    rows = candidates(docs.filter(F.col("doc_id").isNotNull()))
    v, name = F.col("value"), F.lower("key")
    random = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & (F.regexp_count(v, F.lit("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])")) >= 4)
    plain = v.rlike("^[A-Za-z][a-z]+$") | v.rlike("^[A-Z]+$") | v.rlike("^[0-9]+(?:-[0-9]+)*$") | v.rlike("^[-=_+/]+$") | v.rlike("^(?:[A-Z]?[a-z]{2,}){2,6}$") | v.rlike("^/?[A-Za-z]{2,}(?:[-_/][A-Za-z]{2,})+/?$")
    kind = F.when(v.rlike(KNOWN) | name.rlike(TELLING) & random, 1).when(plain & ~name.rlike(TELLING), 0)
    return rows.select("value", "key", "before", "after", "path", kind.alias("secret")).filter("secret is not null")


def described(rows: DataFrame, known_words: str = DICTIONARY) -> DataFrame:
    """rows with the columns of FEATURES."""
    v, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.regexp_count(v, F.lit(pattern)) / n
    around = F.lower(F.concat_ws(" ", "key", "before", "after"))
    kinds = sum(v.rlike(p).cast("double") for p in ("[a-z]", "[A-Z]", "[0-9]", r"[+/_=\-]"))
    found = {
        "length": n,
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "lower": share("[a-z]"),
        "kinds": kinds,
        "changes": share("[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "digit_changes": share("[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])"),
        "distinct": F.size(F.array_distinct(F.split(v, ""))) / n,
        "hex": v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$").cast("double"),
        "only_digits": v.rlike("^[0-9]+$").cast("double"),
        "covered": 1 - F.length(F.regexp_replace(F.lower("value"), known_words, "")) / n,
        "vowels": F.regexp_count(F.lower("value"), F.lit("[aeiou]")) / (F.regexp_count(v, F.lit("[A-Za-z]")) + 1),
        "slashes": F.regexp_count(v, F.lit("/")).cast("double"),
        "path": F.col("path").rlike(r"[/\\.]|://").cast("double"),
        "dashes": F.regexp_count(v, F.lit("[-_]")).cast("double"),
        "telling": around.rlike(TELLING).cast("double"),
        "harmless": around.rlike(rf"(?:^|[^a-z])(?:{HARMLESS})(?:[^a-z]|$)").cast("double"),
        "assigned": (F.col("key") != "").cast("double"),
        "quoted": F.col("path").rlike("[\"']$").cast("double"),
        "known": v.rlike(KNOWN).cast("double"),
    }
    text = {c: F.coalesce(F.col(c), F.lit("")) for c in ("key", "before", "after", "path")}
    return rows.withColumns(text).withColumns({k: F.coalesce(x.cast("double"), F.lit(0.0)) for k, x in found.items()})


def examples(spark: SparkSession, each: int = 400) -> DataFrame:
    """Labelled findings made by rule: `each` rows of each form."""
    hex_ = "sha2(cast(id as string), 512)"
    mixed = f"translate(base64(unhex({hex_})), '+/=\\n', 'xyz')"
    shown = "element_at(array('password','token','secret','api_key','auth_token','access_key','client_secret'), cast(id % 7 as int) + 1)"
    plain = "element_at(array('the','of','and','in','with','was','for','by'), cast(id % 8 as int) + 1)"
    other = "element_at(array('commit','sha','id','uuid','order','checksum','invoice','version'), cast(id % 8 as int) + 1)"
    letters = f"translate(base64(unhex({hex_})), '+/=\\n0123456789', 'xyzQabcdefghij')"
    said = lambda *at: ", ".join(f"element_at(array('th','re','ing','tion','er','an','con','mo','ver','li','ous','ble','st','que','ein','ado'), cast(pmod(xxhash64(id, {k}), 16) as int) + 1)" for k in at)
    named = "element_at(array('client_secret','aws_secret_access_key','authorization','private_key_id','access_token_url','refresh_token','api_key_header','secret_manager'), cast(id % 8 as int) + 1)"
    forms = [
        (f"concat('AKIA', upper(translate(substr({hex_}, 1, 16), '0189', 'QXZV')))", "''", plain, "''", 1),
        (f"concat('AKIA', upper(substr({mixed}, 3, 16)))", "''", plain, "''", 1),
        (f"substr({hex_}, 1, 40)", shown, "'='", "'\"'", 1),
        (f"substr({hex_}, 5, 18)", shown, plain, f"concat({shown}, '=')", 1),
        (f"substr({hex_}, 9, 32)", shown, "':'", "''", 1),
        (f"substr({mixed}, 1, 24 + cast(id % 20 as int))", shown, "'='", "'\"'", 1),
        (f"substr({mixed}, 1, 40)", "''", "'bearer'", "''", 1),
        (f"concat('ghp_', substr({mixed}, 1, 36))", "''", plain, "''", 1),
        (f"translate(substr({hex_}, 1, 16), 'abcdef', '012345')", "''", plain, "''", 0),
        (f"translate(substr({hex_}, 1, 12 + cast(id % 8 as int)), 'abcdef', '678912')", other, "'='", "''", 0),
        (f"substr({hex_}, 1, 40)", "''", other, "''", 0),
        (f"concat_ws('-', substr({hex_},1,8), substr({hex_},9,4), substr({hex_},13,4), substr({hex_},17,4), substr({hex_},21,12))", "''", other, "''", 0),
        ("concat('20', 10 + id % 20, '-0', 1 + id % 9, '-1', id % 10, 'T10-20-30')", "''", plain, "''", 0),
        ("concat('static/image_', id, '/page')", "''", plain, "'https://cdn.example.com/'", 0),
        ("concat('report_final_', id)", "''", plain, "''", 0),
        ("concat('configServerHandler', id % 100)", "''", plain, "''", 0),
        (f"substr({letters}, 1, 24 + cast(id % 20 as int))", shown, "'='", "'\"'", 1),
        (f"substr({letters}, 1, 40)", "''", "'bearer'", "''", 1),
        (f"concat({said(1, 2, 3, 4, 5, 6)})", "''", plain, "''", 0),
        (f"concat({said(1, 2, 3, 4, 5)})", shown, "':'", "''", 0),
        (f"initcap(concat({said(1, 2, 3, 4, 5, 6)}))", "''", plain, "''", 0),
        (f"concat(initcap(concat({said(1, 2)})), initcap(concat({said(3, 4)})), initcap(concat({said(5, 6)})))", "''", plain, "''", 0),
        (f"upper(concat({said(1, 2, 3, 4, 5, 6)}))", "''", plain, "''", 0),
        (f"upper(concat({said(1, 2, 3, 4, 5)}))", shown, "':'", "''", 0),
        (f"concat_ws('-', concat({said(1, 2)}), concat({said(3, 4, 5)}), concat({said(6, 7)}))", other, "''", "''", 0),
        (f"concat_ws('/', '', concat({said(1, 2)}), concat({said(3, 4, 5)}), concat({said(6, 7)}))", "''", plain, "'https:'", 0),
        (f"concat('com/', concat({said(1, 2)}), '/', concat({said(3, 4, 5)}), '_', concat({said(6, 7)}))", "''", plain, "'https://www.example.'", 0),
        (named, "''", plain, "'\"'", 0),
        ("concat('section-', id, '-chapter-', id % 9)", "''", plain, "'/docs/'", 0),
    ]
    out = None
    for k, (value, key, before, path, secret) in enumerate(forms):
        part = spark.range(k * 100_000, k * 100_000 + each).selectExpr(
            f"{value} value", f"{key} key", f"{before} before", f"{plain} after", f"{path} path", f"{secret} secret"
        )
        out = part if out is None else out.unionByName(part)
    return out


def folded(findings: DataFrame, known_words: str = DICTIONARY) -> DataFrame:
    """(secret, the columns of FEATURES, weight): findings of equal features as one row."""
    known = findings.filter("value is not null and secret is not null").withColumn("secret", F.col("secret").cast("double"))
    return described(known, known_words).groupBy("secret", *FEATURES).agg(F.count(F.lit(1)).cast("double").alias("weight"))


def fitted(docs: DataFrame, **how) -> Scanner:
    """A scanner that has learnt from all documents and from the examples."""
    return Scanner(examples(docs.sparkSession), labelled(docs), known_words=dictionary(docs), **how)


class Scanner:
    """A forest fitted on labelled findings; `more`, findings that together weigh no more than the others."""

    def __init__(self, findings: DataFrame, more: DataFrame | None = None, *, known_words: str = DICTIONARY, trees: int = 24, depth: int = 7, seed: int = 4):
        self.known_words = known_words
        known = cut(folded(findings, known_words))
        if more is not None:
            more = cut(folded(more, known_words))
            own, all_more = (x.agg(F.sum("weight")).first()[0] or 0.0 for x in (known, more))
            share = min(1.0, own / all_more) if own and all_more else 1.0
            known = known.unionByName(more.withColumn("weight", F.col("weight") * share))
        kinds = [r.secret for r in known.select("secret").distinct().collect()]
        self.only = None if len(kinds) > 1 else (kinds or [0.0])[0]
        self.assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        if self.only is None:
            forest = RandomForestClassifier(labelCol="secret", featuresCol="features", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)
            # Parts and their order by the rows themselves, so that the forest is the same however the documents lie.
            known = known.repartition(16, *FEATURES).sortWithinPartitions(*FEATURES, "secret", "weight")
            self.model = forest.fit(self.assemble.transform(known))

    def scan(self, docs: DataFrame, least: float = 0.5) -> DataFrame:
        """(doc_id, word_at, value, key, score, secret) of every candidate."""
        found = described(candidates(docs), self.known_words)
        if self.only is not None:
            found = found.withColumn("score", F.lit(self.only))
        else:
            found = self.model.transform(self.assemble.transform(found)).withColumn("score", F.round(vector_to_array("probability")[1], 6))
        return found.select("doc_id", "word_at", "value", "key", "score", (F.col("score") >= least).alias("secret"))
