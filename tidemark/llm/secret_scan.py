"""Secret scan: candidate strings, judged by a random forest. DataFrame operations only.

Candidates are runs of 16 or more key characters that hold a digit or stand behind a word such as "password"; the name in
`SOME_SECRET_NAME = value` is none. So are quoted or unspaced values of 6 or more characters behind a secret word and = or :, if no such
run is found in them; these are numbered after the runs. The forest looks at length, character classes and the transitions between them, coverage by
dictionary words, the path and the neighbouring words (the 48 characters before, whatever they are, and the rest of the line among the 24 after), and is trained from labelled findings. It removes false positives: checksums, commit ids, identifiers, numbers, placeholders.

Training. `labelled_findings` makes a labelled table from the kinds of findings that a reviewer meets (fixed
templates below, values from hashes of a running number); callers with reviewed findings of their own pass those. The
training table is the bounded part (`rows`); the scan reads every whole text.

Scale. The scan is one pass without shuffle: texts become candidates inside the task that reads them. The
model is a few hundred kilobytes.

Defined results. Null and empty texts have no candidates; texts of any length are scanned whole; other columns, whatever their names, are not read; an empty table gives an empty result; repeated rows each give theirs; a null path says nothing. Findings
show the digest and the first four characters, not the value."""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A secret word may begin a longer name: "passw" that of password, "secret" that of SECRET_VALUE.
SECRET_WORDS = r"((?:secret|token|passw|passphrase|pwd|api[ _-]?key|apikey|access[ _-]?key|auth|bearer|credential|private[ _-]?key|client[ _-]?key)[\w-]{0,24})"
#: The sign between a name and its value.
SIGN = r"[\"'`\]]{0,2}[ \t]{0,4}(?:=>|[:=]{1,2})[ \t]{0,4}"
#: A name with a secret word in it, a sign and the beginning of a value.
NAME = r"(?=[A-Za-z0-9_/-]{0,80}?(?i:" + SECRET_WORDS + r"))[A-Za-z]{1,64}[0-9]{0,2}(?:[_/-]{1,2}(?:[A-Za-z]{1,64}[0-9]{0,2}|[0-9]{1,4})){0,12}" + SIGN + r"[\"'`]?[^\s\"'`=,;)\]}]"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?!" + NAME + r")[A-Za-z0-9+/_-]{16,}+={0,2}"
#: A secret word, a sign, and a quoted value or one without space, of 6 characters or more.
ASSIGNED = r"(?i:" + SECRET_WORDS + r")" + SIGN + r"(?:\"[^\"\n]{6,}+\"|'[^'\n]{6,}+'|`[^`\n]{6,}+`|[\"'`]?[^\s\"'`]{6,}+)"
#: What stands before the value in a match of ASSIGNED.
LEAD = r"^(?i:" + SECRET_WORDS + r")" + SIGN + r"[\"'`]?"
#: Assigned values that runs already give: one begins with a run, or holds a run with a digit.
HAS_RUN = "^" + CANDIDATE + r"|(?<![A-Za-z0-9+/_-])(?!" + NAME + r")(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{16,}"
OTHER_WORDS = r"(commit|sha1|sha256|sha512|md5|checksum|digest|etag|hash|uuid|guid|revision|version|merge|image|base64|nonce|build|session id|trace|order|invoice|card)"
#: Words that names and placeholders are made of.
DICTIONARY = (
    "access account address admin application array backup bucket button cache change client cloud color column command config connection "
    "content context controller count create customer data database date default delete demo description display document domain download dummy "
    "email enable environment error event example factory feature field file filter format function group handler header height here history "
    "home http image index input insert integer interface item java key language layout length level list local location login manager master "
    "message method model module name network number object option order output package page parameter parent password path payment picture "
    "placeholder plugin position prefix private process product profile project property provider public query question record remove replace "
    "report request resource response result role sample schema script search secret section select server service session setting simple "
    "source status storage string style system table target template test text thread time title token transaction type update upload user "
    "utils value version video view widget width window with your"
).split()

FEATURES = ["length", "digits", "uppers", "lowers", "symbols", "transitions", "variety", "consonants", "hexadecimal", "dictionary", "near_secret", "near_other", "assigned", "quoted", "path_test", "path_config", "after_other", "closed"]


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None = None) -> DataFrame:
    """(id, finding, value, before, after, path, context): one row per candidate, numbered within its text.

    A text is taken apart at its candidates: the pieces in between hold the neighbouring words. context: the last 48 characters
    before the value, earlier candidates included (three of them fill it)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    taken = lambda rule: (F.regexp_extract_all(text, F.lit(rule), F.lit(0)), F.split(text, rule, -1))
    (values, pieces), (named, between) = taken(CANDIDATE), taken(ASSIGNED)
    parts = docs.select(F.col(id_col).alias("id"), path.alias("path"), values.alias("values"), pieces.alias("pieces"), named.alias("named"), between.alias("between"))
    parts = parts.where((F.size("values") > 0) | (F.size("named") > 0)).withColumn("pieces", F.transform("pieces", lambda p: F.struct(F.left(p, F.lit(24)).alias("head"), F.right(p, F.lit(48)).alias("tail"))))
    joined = F.transform("values", lambda v, i: F.concat(F.when(i > 0, F.right(F.get(F.col("values"), i - 1), F.lit(48))).otherwise(F.lit("")), F.get(F.col("pieces"), i)["tail"]))
    parts = parts.withColumn("joined", joined)
    context = lambda i: F.right(F.array_join(F.slice("joined", F.greatest(i - 2, F.lit(1)), F.least(i + 1, F.lit(4))), ""), F.lit(48))
    zipped = F.transform("values", lambda v, i: F.struct(i.alias("finding"), v.alias("value"), F.get(F.col("pieces"), i)["tail"].alias("before"), F.get(F.col("pieces"), i + 1)["head"].alias("after"), context(i).alias("context")))
    runs = F.filter(zipped, lambda c: c["value"].rlike("[0-9]") | F.lower(c["context"]).rlike(SECRET_WORDS + r"\W{0,12}$"))

    def assigned(match: Column, i: Column) -> Column:
        lead = F.regexp_extract(match, LEAD, 0)
        rest = F.substring(match, F.length(lead) + 1, F.length(match))
        value = F.regexp_replace(rest, F.when(lead.rlike("[\"'`]$"), F.lit("[\"'`]$")).otherwise(F.lit(r"[,;.)\]}>]+$")), F.lit(""))
        before = F.right(F.concat(F.right(F.get(F.col("between"), i), F.lit(48)), lead), F.lit(48))
        after = F.left(F.concat(F.substring(rest, F.length(value) + 1, F.lit(24)), F.left(F.get(F.col("between"), i + 1), F.lit(24))), F.lit(24))
        return F.struct((F.size("values") + i).alias("finding"), value.alias("value"), before.alias("before"), after.alias("after"), before.alias("context"))

    others = F.filter(F.transform("named", assigned), lambda c: (F.length(c["value"]) >= 6) & ~c["value"].rlike(HAS_RUN))
    found = parts.select("id", "path", F.explode(F.concat(runs, others)).alias("c"))
    return found.select("id", "c.finding", "c.value", "c.before", "c.after", "path", "c.context")


def _share(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern)) / F.length(value)


def add_features(found: DataFrame) -> DataFrame:
    """found: value, after, path, and before or (as candidates gives it) context."""
    after = F.lower(F.coalesce(F.col("after"), F.lit("")))
    value, before, path = F.col("value"), F.lower(F.coalesce(F.col("context" if "context" in found.columns else "before"), F.lit(""))), F.lower(F.coalesce(F.col("path"), F.lit("")))
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(value, "[^A-Za-z0-9]", "-"), "[a-z]", "a"), "[A-Z]", "A"), "[0-9]", "0")
    words = "|".join(sorted(set(DICTIONARY), key=lambda w: (-len(w), w)))
    return found.withColumns(
        {
            "length": F.least(F.length(value), F.lit(256)).cast("double"),
            "digits": _share(value, "[0-9]"),
            "uppers": _share(value, "[A-Z]"),
            "lowers": _share(value, "[a-z]"),
            "symbols": _share(value, "[^A-Za-z0-9]"),
            "transitions": F.length(F.regexp_replace(classes, r"(.)\1+", "$1")) / F.length(value),
            "variety": F.size(F.array_distinct(F.split(value, ""))) / F.least(F.length(value), F.lit(64)),
            "consonants": _share(F.lower(value), "[b-df-hj-np-tv-z]{3,}"),
            "hexadecimal": value.rlike("^([0-9a-f]+|[0-9A-F]+)$").cast("double"),
            "dictionary": 1 - F.length(F.regexp_replace(F.lower(value), words, "")) / F.length(value),
            "near_secret": before.rlike(SECRET_WORDS).cast("double"),
            "near_other": before.rlike(OTHER_WORDS).cast("double"),
            "assigned": before.rlike(r"[=:]\s*[\"'`]?$").cast("double"),
            "quoted": before.rlike("[\"'`]$").cast("double"),
            "path_test": path.rlike(r"(test|example|sample|fixture|mock|demo|doc|readme)").cast("double"),
            "path_config": path.rlike(r"(\.env|config|setting|deploy|secret|credential|\.ya?ml|\.ini|\.tf)").cast("double"),
            "after_other": after.rlike(r"^[^\n]*?" + OTHER_WORDS).cast("double"),
            "closed": after.rlike("^[\"'`]").cast("double"),
        }
    )


def labelled_findings(spark: SparkSession, rows: int = 6000, seed: int = 3, part: int | None = None) -> DataFrame:
    """(value, before, after, path, label): labelled findings, the same for the same arguments on any cluster.

    part: 0 or 1 for one half of the templates, names and words only, which the other half does not have."""
    half = lambda options: options if part is None else options[part::2]
    pick = lambda salt, options: F.element_at(F.array(*[F.lit(o) for o in half(options)]), (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(len(half(options)))) + 1).cast("int"))
    hexed = lambda salt: F.sha2(F.concat_ws(":", F.lit(seed), F.lit(salt), "id"), 256)
    coded = F.regexp_replace(F.base64(F.unhex(hexed("b"))), "[=]", "")
    word = lambda salt: pick(salt, sorted(set(DICTIONARY)))
    odd = lambda salt: pick(salt, ["on", "er", "thre", "ation", "ing", "lich", "mente", "eaux", "sch", "wh", "nd", "re", "st", "que"])
    long_word = F.concat(*[odd(f"w{k}") for k in range(7)])
    digits = F.lpad(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(10**16)).cast("string"), 16, "4")
    uuid = F.concat_ws("-", *[F.substring(hexed("u"), a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    secret_name = pick("s", ["token", "api_key", "API_KEY", "secret", "SECRET_KEY", "password", "auth_token", "access_key", "client_secret", "TOKEN", "PASSWORD", "private_key", "credentials"])
    assign = pick("a", [' = "', "=", ": ", '": "', " = '", ':"', " "])
    keyed = F.concat(pick("p", ["", "export ", "the ", "; ", "\n", "  ", "lorem ipsum "]), secret_name, assign)
    prose = F.concat(odd("x"), odd("y"), F.lit(" "), word("z"), pick("q", [" ", ", ", ". ", "\n", " | ", ' "', " = ", ": ", '="']))
    other = F.concat(pick("o", ["commit ", "sha256:", "md5: ", "checksum=", "etag: \"", "digest: ", "revision ", "Merge ", "uuid=", "data:image/png;base64,", "build ", "hash = \"", "version ", "trace "]))
    plain_path = pick("f", [None, None, "src/main.py", "app/models/user.rb", "config/prod.yaml", ".env", "deploy/settings.ini", "notes.txt"])
    test_path = pick("t", ["tests/test_login.py", "docs/example.md", "spec/fixtures/keys.yml", "examples/demo.py", "README.md"])
    hex40, hex32, b64, mixed = F.substring(hexed("h"), 1, 40), F.substring(hexed("g"), 1, 32), F.substring(coded, 1, 40), F.substring(F.regexp_replace(coded, "[+/]", "x"), 1, 24)
    ends = pick("e", ["\n", " ", "", ";", ",", ", "])
    behind = pick("v", [" is the commit", "  checksum ok", " (sha256 of the image)", " release.tar.gz: sha1", " md5 of the file", ", the digest", " order no.", " build id"])
    kinds = [  # (value, before, path, label, after: as the assignment closes it, if it is not given)
        (hex40, prose, plain_path, 0, behind), (hexed("i"), prose, plain_path, 0, behind),
        (hex40, keyed, plain_path, 1), (F.upper(hex40), keyed, plain_path, 1), (hex32, keyed, plain_path, 1), (b64, keyed, plain_path, 1), (mixed, keyed, plain_path, 1), (hexed("i"), keyed, plain_path, 1),
        (F.concat(F.lit("AKIA"), F.upper(F.substring(mixed, 1, 16))), F.coalesce(keyed, prose), plain_path, 1), (F.concat(F.lit("ghp_"), F.substring(F.regexp_replace(coded, "[+/]", "q"), 1, 36)), prose, plain_path, 1),
        (F.concat(F.lit("sk_live_"), mixed), prose, plain_path, 1),
        (hex40, other, plain_path, 0), (hex32, other, plain_path, 0), (hexed("i"), other, plain_path, 0), (b64, other, plain_path, 0), (uuid, prose, plain_path, 0), (uuid, other, plain_path, 0), (uuid, keyed, test_path, 0),
        (digits, prose, plain_path, 0), (digits, other, plain_path, 0), (long_word, prose, plain_path, 0), (F.concat(long_word, F.lit("2")), prose, plain_path, 0), (long_word, keyed, plain_path, 0),
        (F.concat_ws("_", word("1"), word("2"), word("3")), keyed, plain_path, 0), (F.concat(word("1"), F.initcap(word("2")), F.initcap(word("3")), F.lit("2")), prose, plain_path, 0),
        (F.concat_ws("/", word("1"), word("2"), word("3"), F.lit("v2")), prose, plain_path, 0), (F.lit("xxxxxxxxxxxxxxxxxxxxxxxx"), keyed, plain_path, 0), (F.lit("your_api_key_here_1234"), keyed, plain_path, 0),
        (F.concat(F.lit("0000000000000000"), F.substring(digits, 1, 4)), keyed, plain_path, 0), (hex40, keyed, test_path, 0), (mixed, keyed, test_path, 0), (hex40, prose, plain_path, 0),
        (F.substring(mixed, 1, 10), keyed, plain_path, 1), (F.concat(odd("m"), odd("n"), F.substring(digits, 9, 2), pick("c", ["!", "@", "#", "$", "-", ".", "!x", "-abc"]), F.substring(digits, 12, 2)), keyed, plain_path, 1),
        (word("4"), keyed, plain_path, 0), (F.concat(odd("k"), odd("l")), keyed, plain_path, 0), (F.substring(mixed, 1, 10), keyed, test_path, 0),
        (F.concat(word("5"), F.substring(digits, 7, 1), pick("g", ["-", "_", "!", "#", ".", "@"]), F.substring(hexed("f"), 1, 4)), keyed, plain_path, 1),
    ]
    kinds = half(kinds)
    made = spark.range(0, rows, 1, 8).withColumn("kind", F.col("id") % len(kinds))  # a fixed number of partitions, which the forest's samples depend on
    choose = lambda k: F.coalesce(*[F.when(F.col("kind") == i, x[k] if isinstance(x[k], Column) else F.lit(x[k])) for i, x in enumerate(kinds)])
    told = F.coalesce(*[F.when(F.col("kind") == i, x[4]) for i, x in enumerate(kinds) if len(x) > 4], F.lit(None).cast("string"))
    made = made.select("id", choose(0).alias("value"), choose(1).alias("before"), told.alias("told"), choose(2).alias("path"), choose(3).cast("double").alias("label"))
    closing = F.concat(F.when(F.col("before").rlike("\"$"), F.lit('"')).when(F.col("before").rlike("'$"), F.lit("'")).otherwise(F.lit("")), ends)
    return made.select("value", "before", F.coalesce("told", closing).alias("after"), "path", "label")


def train_forest(labelled: DataFrame, trees: int = 24, depth: int = 9, seed: int = 17) -> RandomForestClassificationModel:
    """labelled: value, before, after, path, label (1: a secret)."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(add_features(labelled))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt").fit(vectors.select("features", "label"))


def scan_secrets(docs: DataFrame, model: RandomForestClassificationModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """One row per candidate: id, finding, length, starts_with, value_sha256, probability, secret."""
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(add_features(candidates(docs, id_col, text_col, path_col)))
    judged = model.setProbabilityCol("probability").transform(vectors)
    probability = F.round(F.element_at(vector_to_array("probability"), 2), 6)
    return judged.select(F.col("id").alias(id_col), "finding", F.length("value").alias("length"), F.left("value", F.lit(4)).alias("starts_with"), F.sha2("value", 256).alias("value_sha256"), probability.alias("probability"), (probability >= threshold).alias("secret"))
