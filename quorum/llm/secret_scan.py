"""Secret scans: a random forest over regex candidates, with DataFrame functions only.

Candidates are long tokens (letters, digits and ``+/_.-``) with a digit or with the beginning of a well-known issuer's keys; the
password in a URL's ``user:password@``; what follows a name like ``password`` or ``the token is`` and holds a digit; or what is
assigned to a name by ``=``, ``:``, ``:=`` or ``=>``: a quoted value whole, with its spaces, if its line closes the quote; else any
characters but spaces, of any number, with or without a digit, up to a quote, trailing punctuation, or a separator before the
next ``name=``. A scheme (``Bearer``, ``Basic``, ``Token``) before a value is no part of it and never a
candidate, nor is a name that its own colon follows. A random forest on their length,
character transitions, dictionary coverage, path, issuer's prefix and neighbouring words removes the false positives. The
forest is trained by Spark's own RandomForestClassifier from labelled findings and is then written as nested CASE expressions, which run inside one pass over the texts: no candidate leaves its document's row.

Labelled findings have (candidate, before, path, label). Without any, ``labelled_findings`` makes LABELLED of them from
rules: keys in assignments, in prose, in URLs and alone, with issuers' lengths and alphabets, against ids, numbers, addresses,
ports, checksums, placeholders, sentences and words. The pattern runs over each text once.

Defined cases: a null text or path is empty; very long texts are scanned whole; a score equal to the threshold is a
secret; an empty table gives no rows; repeated rows and repeated secrets are all reported, each with its place among the
candidates of its text; secrets of fewer than LONG_CHARS characters are masked
where they stand as words of their own, longer ones wherever they occur; the noncharacters of MARKS part candidates as line
breaks do; further columns of the input, whatever their names, are kept by ``redact`` and
``with_findings``, whose new column has underscores put in front of its name while the input has one of that name.
"""

from __future__ import annotations

import uuid

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quorum.llm.common import cut, removed, shared_dir, unused

BEFORE_CHARS = 48
#: From this length on, a token needs no assignment, and a secret is masked within other tokens, too.
LONG_CHARS = 16
MARK = "[SECRET]"
THRESHOLD = 0.5
#: Bounds of the training: labelled findings, trees and their depth.
LABELLED, TREES, DEPTH = 4_000, 12, 6
#: Words whose presence makes a token readable, and words near secrets and near harmless ids.
WORDS = "the and for with that from this have your page file path name user test data info blog news mail http https www com org net html json text image index class object string number value list item order report select return import public static void example sample dummy placeholder changeme lorem ipsum version release build config default local host server client service account project module package library system".split()
NEAR_SECRET = r"(?i)(secret|token|passw|pwd|api.?key|auth|credential|private|bearer|access.?key|signing)"
NEAR_HARMLESS = r"(?i)(sha\d*|md5|checksum|digest|commit|revision|uuid|guid|etag|hash|integrity|example|sample|dummy|card|phone|order|invoice|isbn)"
_KEYWORD = NEAR_SECRET.replace("(?i)(", "(?:")
_ASSIGN = r"(?::=|=>|[=:](?![=:]|//))"
#: Schemes that stand between a header's name and its secret, and names that a secret may follow in prose.
_SCHEME = r"(?:bearer|basic|token|digest)"
_TOLD = r"(?:password|passwd|passphrase|pwd|passcode|secret|token|credential|(?:api|access|private|signing)[ _-]?key)"
#: The name that a candidate is assigned to holds a word near secrets.
NAMED_SECRET = rf"(?i){_KEYWORD}[\w.\-]*[\"'`\])]{{0,2}}\s*(?::=|=>|[=:])\s*(?:{_SCHEME}\s+)?[\"'`]?$"
TOLD_SECRET = rf"(?i)(?<!\w){_TOLD}\s+(?:(?:is|was)\s+)?[\"'`]?$"
AFTER_SCHEME = rf"(?i)(?<!\w){_SCHEME}\s+$"
USER_INFO = r"://[^\s/:@]{1,64}:$"
#: How keys of well-known issuers begin.
_ISSUER = r"(?:sk_live_|sk_test_|rk_live_|gh[pousr]_|github_pat_|AKIA|ASIA|xox[abeprs]-|glpat-|AIza|SG\.|npm_|hf_)[A-Za-z0-9_\-.]{12}"
ISSUED = f"^{_ISSUER}"
#: Noncharacters that part what the pattern finds: before a find, before its candidate, and after it.
MARKS = "\ufdd0\ufdd1\ufdd2"
TEST_PATH = r"(?i)(test|example|sample|doc|fixture|mock|lock|vendor|node_modules)"


def _candidate_pattern() -> str:
    """Group 3 is the candidate, group 4 what stands before it on its line; possessive loops, as texts may be long."""
    next_name = r"[A-Za-z_][\w.\-]{0,63}=[^\s=]"
    secret_name = rf"(?i:[\w.\-]{{0,32}}{_KEYWORD}[\w.\-]{{0,32}})[\"']?[=:][^\s=]"
    user_info = r"(?<=://[^\s/:@]{1,64}:)[^\s/@\"'`]++(?=@)"
    whole = "|".join(rf"(?<={q})[^\s{q}]++(?:[ \t]++[^\s{q}]++)++(?={q})" for q in "\"'`")
    quoted = "|".join(rf"(?<={q})(?:[^\s{q}?&]++|[?&](?!{secret_name}))++" for q in "\"'`")
    marks = r",;.)\]}'>"  # not part of a value that they end
    bare = rf"(?<![\"'`])(?!{secret_name})(?![\w.\-]{{1,64}}:(?:\s|\z))(?:[^\s\"`?&|{marks}]++|[?&|](?!{next_name})|[{marks}]++(?![\s\"`]|\z|{next_name}))++"
    token = r"[A-Za-z0-9+/_.\-]"
    padding = r"(?:={1,2}(?=[,;)\]}\n\r.]|[\"'`](?:[\s,;)\]}]|\z)|\z)|==(?=\s))?"
    long = rf"(?:(?=[A-Za-z+/_.\-]*+[0-9])|(?={_ISSUER}))(?!\.){token}{{{LONG_CHARS},}}+{padding}"
    scheme = rf"(?:(?i:{_SCHEME})[ \t]{{1,4}}(?=[^\s]))?+"
    assigned = rf"(?<=[\p{{L}}_][0-9]{{0,4}}[\"'`\])]{{0,2}}[ \t]{{0,4}}){_ASSIGN}[ \t]{{0,8}}(?:[(\[{{<]{{1,3}}(?=[\"'`]))?[\"'`]?{scheme}()"
    told = rf"(?<![\w])(?i:{_TOLD})[ \t]{{1,4}}(?:(?i:is|was)[ \t]{{1,4}})?+[\"'`]?()(?=[^\s0-9]*+[0-9])(?=[^\s]{{6}})"
    no_scheme = rf"(?!(?i:{_SCHEME})(?![^\s\"'`,;]))"
    before = rf"(?:[^\n]{{{BEFORE_CHARS}}}|(?<![^\n])[^\n]{{0,{BEFORE_CHARS - 1}}})"
    return rf"(?:{assigned}|{told}|(?<!{token}))(?=(\1{no_scheme}(?:{user_info}|{whole}|{quoted}|{bare})|\2(?:{quoted}|{bare})|{long}))(?<=({before}))\3"


CANDIDATE = _candidate_pattern()


def features(candidate: Column, before: Column, path: Column) -> dict[str, Column]:
    """The forest's inputs, by name."""
    n = F.length(candidate)
    share = lambda pattern: F.regexp_count(candidate, F.lit(pattern)) / n
    uncovered = F.length(F.regexp_replace(F.lower(candidate), "|".join(sorted(WORDS, key=len, reverse=True)), ""))
    flag = lambda c, pattern: F.coalesce(c.rlike(pattern), F.lit(False)).cast("double")
    return {
        "length": n.cast("double"),
        "digits": share("[0-9]"),
        "upper": share("[A-Z]"),
        "marks": share(r"[+/_=.\-]"),
        "transitions": share("[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"),
        "consonants": share("(?i)[bcdfghjklmnpqrstvwxz](?=[bcdfghjklmnpqrstvwxz])"),
        "not_hex": share("[^0-9a-fA-F]"),
        "distinct": F.size(F.array_distinct(F.split(candidate, ""))) / n,
        "dictionary": F.lit(1.0) - uncovered / n,
        "dots": share(r"\."),
        "near_secret": flag(before, NEAR_SECRET),
        "near_harmless": flag(before, NEAR_HARMLESS),
        "named_secret": flag(before, NAMED_SECRET),
        "assigned": flag(before, r"[=:]>?\s*[\"']?$"),
        "quoted": flag(before, r"[\"']$"),
        "issued": flag(candidate, ISSUED),
        "spaces": share(r"\s"),
        "told_secret": flag(before, TOLD_SECRET),
        "after_scheme": flag(before, AFTER_SCHEME),
        "user_info": flag(before, USER_INFO),
        "test_path": flag(path, TEST_PATH),
    }


def labelled_findings(spark: SparkSession, n: int = LABELLED) -> DataFrame:
    """n labelled findings (candidate, before, path, label) made by rule: every other one is a secret."""
    seed = F.sha2(F.concat(F.lit("finding "), F.col("id").cast("string")), 512)
    rows = spark.range(n).withColumn("seed", seed)
    draw = lambda at, size: F.conv(F.substr("seed", F.lit(at), F.lit(6)), 16, 10).cast("long") % size
    listed = lambda of: F.split(F.lit("\n".join(of)), "\n") if isinstance(of[0], str) else F.array(*[F.lit(x) for x in of])
    one = lambda at, *of: F.element_at(listed(of), (draw(at, len(of)) + 1).cast("int"))
    hexes = F.substr("seed", F.lit(30), F.element_at(F.array(F.lit(20), F.lit(32), F.lit(40), F.lit(64)), (draw(1, 4) + 1).cast("int")))
    base64 = F.regexp_replace(F.base64(F.unhex(F.substr("seed", F.lit(40), F.lit(60)))), "=", "")
    key = F.when(draw(7, 10) < 5, hexes).when(draw(7, 10) < 6, F.upper(hexes)).otherwise(base64)
    key = F.when(draw(13, 12) == 0, F.concat(one(19, "sk_live_", "ghp_", "AKIA", "xoxb-", "glpat-"), base64)).otherwise(key)
    short = lambda at, least, most, of: F.translate(F.substr("seed", F.lit(at), (draw(at + 20, most - least + 1) + least).cast("int")), "0123456789abcdef", of)
    typed = F.concat(F.initcap(one(80, *WORDS)), one(84, "", "4", "0u", "er", "x!"), (draw(88, 9_000) + 10).cast("string"), one(92, "", "!", "#", "&3", "$"))
    password = one(96, 0, 1, 2, 3)
    password = (
        F.when(password == 0, short(70, 8, 14, "0!3a5@dT8#rGk&uQ"))  # digits, letters and marks
        .when(password == 1, short(72, 8, 20, "kqzXvTbRwMnpLhGs"))  # letters
        .when(password == 2, short(74, 8, 16, "kaz-vobRw!nePuGi"))
        .otherwise(typed)
    )
    key = F.when(draw(100, 4) == 0, password).otherwise(key)
    name = one(25, "token", "api_key", "secret", "password", "auth_token", "access_key", "private_key", "TOKEN", "client_secret")
    lead = F.concat(one(31, "", "the of and ", "export ", "config: ", "und die ", "que la "), name, one(37, ' = "', "=", ": ", ' = "', " = '", ' : "'))
    digits = F.substr(F.regexp_replace("seed", "[^0-9]", ""), F.lit(1), F.lit(16))
    id_ = F.concat_ws("-", *[F.substr("seed", F.lit(a), F.lit(k)) for a, k in ((40, 8), (48, 4), (52, 4), (56, 4), (60, 12))])
    word = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda k: F.element_at(listed(WORDS), (F.conv(F.substr(F.col("seed"), k * 6, F.lit(6)), 16, 10).cast("long") % len(WORDS) + 1).cast("int"))), "")
    kind = draw(43, 8)
    harmless = (
        F.when(kind == 0, F.struct(digits.alias("c"), F.lit("number the of ").alias("b")))
        .when(kind == 1, F.struct(id_.alias("c"), one(49, "uuid: ", "id = ", "guid ").alias("b")))
        .when(kind == 2, F.struct(hexes.alias("c"), one(49, "sha256: ", "commit ", "md5 ", "checksum = ").alias("b")))
        .when(kind == 3, F.struct(F.concat(word, F.lit(".example.com")).alias("c"), one(49, "at ", "see ", "the ").alias("b")))
        .when(kind == 4, F.struct(F.concat(word, F.lit("/"), word).alias("c"), one(49, "in ", "path: ", "open ").alias("b")))
        .when(kind == 5, F.struct(F.concat(F.lit("your_"), word, F.lit("_here")).alias("c"), lead.alias("b")))
        .when(kind == 6, F.struct(F.repeat(one(55, "x", "0", "*", "1"), F.lit(32)).alias("c"), lead.alias("b")))
        .otherwise(F.struct(F.concat(word, word).alias("c"), one(49, "la ", "of the ", 'name = "').alias("b")))
    )
    plain = one(104, "color", "title", "name", "city", "version", "width", "mode", "page", "author", "und", "note")
    plain = F.concat(one(31, "", "the of and ", "export ", "config: ", "und die ", "que la "), plain, one(37, ' = "', "=", ": ", ' = "', " = '", ' : "'))
    assigned = draw(108, 4)
    assigned = (
        F.when(assigned == 0, F.struct(password.alias("c"), plain.alias("b")))
        .when(assigned == 1, F.struct(one(80, *WORDS).alias("c"), F.when(draw(84, 2) == 0, plain).otherwise(lead).alias("b")))
        .when(assigned == 2, F.struct(F.substr(digits, F.lit(1), (draw(84, 5) + 1).cast("int")).alias("c"), F.when(draw(90, 2) == 0, plain).otherwise(lead).alias("b")))
        .otherwise(F.struct(one(84, "true", "false", "null", "None", "required", "string", "changeme", "${TOKEN}", "<token>", "********", "xxxxxxxx", "os.environ", "{", "[", "$1", "it", "a").alias("c"), lead.alias("b")))
    )
    harmless = F.when(draw(112, 3) == 0, assigned).otherwise(harmless)
    secret = F.col("id") % 2 == 0
    mixed = F.regexp_replace(F.base64(F.unhex("seed")), "[+/=]", "")  # some 80 letters and digits
    letters = F.regexp_replace(mixed, "[0-9]", "")
    start = lambda c, n: F.substr(c, F.lit(1), F.lit(n))
    issuer = draw(120, 10)  # issuers' own lengths and alphabets
    bare = (
        F.when(issuer == 0, F.concat(F.lit("sk_live_"), start(mixed, 24)))
        .when(issuer == 1, F.concat(F.lit("ghp_"), start(mixed, 36)))
        .when(issuer == 2, F.concat(F.lit("ghp_"), start(letters, 36)))
        .when(issuer == 3, F.concat(F.lit("AKIA"), start(F.upper(mixed), 16)))
        .when(issuer == 4, F.concat(F.lit("AKIA"), start(F.upper(letters), 16)))
        .when(issuer == 5, F.concat(F.lit("xoxb-"), start(digits, 11), F.lit("-"), start(mixed, 24)))
        .when(issuer == 6, F.concat(F.lit("glpat-"), start(mixed, 20)))
        .when(issuer == 7, F.concat(F.lit("AIza"), start(mixed, 35)))
        .when(issuer == 8, F.concat(F.lit("hf_"), start(letters, 34)))
        .otherwise(F.concat(F.lit("npm_"), start(mixed, 36)))
    )
    free = one(31, "", "the of and ", "see ", "with ", "und die ", "que la ", "use ")
    sentence = F.concat_ws(" ", *[one(k, *WORDS) for k in (62, 68, 74, 80)])
    made_up = F.translate(F.concat_ws(" ", *[F.substr("seed", F.lit(a), F.lit(n)) for a, n in ((60, 6), (66, 5), (71, 7), (78, 5))]), "0123456789abcdef", "abcdefghilmnorst")
    with_digit = F.when(draw(100, 4) == 0, typed).when(draw(100, 4) == 1, F.lower(typed)).when(draw(100, 4) == 2, hexes).otherwise(start(mixed, 20))
    form = draw(116, 12)
    said = (
        F.when(form < 3, F.struct(bare.alias("c"), free.alias("b")))  # needs no name
        .when(form == 3, F.struct(F.when(draw(96, 3) == 0, sentence).otherwise(made_up).alias("c"), F.concat(name, one(37, ' = "', ': "', " = '")).alias("b")))
        .when((form == 4) | (form == 7), F.struct(with_digit.alias("c"), F.concat(free, one(25, "password ", "the token is ", "password is ", "the secret was ", "api key is ", "token ")).alias("b")))
        .when(form == 5, F.struct(F.when(draw(96, 2) == 0, password).otherwise(hexes).alias("c"), F.concat(free, one(25, "postgres://admin:", "https://bot:", "mysql://root:", "amqp://svc:", "redis://user:")).alias("b")))
        .when(form == 6, F.struct(F.when(draw(96, 2) == 0, mixed).otherwise(hexes).alias("c"), one(25, "Authorization: Bearer ", "authorization: Basic ", "Bearer ", "-H 'Authorization: token ").alias("b")))
        .otherwise(F.struct(key.alias("c"), lead.alias("b")))
    )
    other = draw(128 - 8, 10)
    plainly = (
        F.when(other == 0, F.struct(F.when(draw(96, 2) == 0, sentence).otherwise(made_up).alias("c"), F.concat(plain, F.lit('"')).alias("b")))
        .when(other == 1, F.struct(F.concat(start(digits, 4), F.lit("/"), word).alias("c"), one(25, "http://localhost:", "at https://host:", "ws://example:").alias("b")))
        .when(other == 2, F.struct(F.concat(start(digits, 2), one(80, "-character", "-word", "%", " minutes", "th")).alias("c"), F.concat(free, one(25, "password ", "token ", "the secret is ", "token was ")).alias("b")))
        .otherwise(harmless)
    )
    path = one(61, "src/app.py", "web/settings.ini", "docs/readme.md", "tests/fixture.json", "src0", "src7", "")
    one = F.when(secret, said).otherwise(plainly)
    return rows.select(one.alias("one"), path.alias("path"), secret.cast("double").alias("label")).select(F.col("one.c").alias("candidate"), F.col("one.b").alias("before"), "path", "label")


def vectors(labelled: DataFrame) -> DataFrame:
    """(label, features) of labelled findings, as Spark's classifiers take them."""
    named = features(F.col("candidate"), F.col("before"), F.col("path"))
    rows = VectorAssembler(inputCols=list(named), outputCol="features").transform(labelled.select("label", *[c.alias(k) for k, c in named.items()]))
    return rows.select("label", "features")


def fit_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> RandomForestClassificationModel:
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed).fit(vectors(cut(labelled.coalesce(1))))


def read_forest(model: RandomForestClassificationModel, spark: SparkSession) -> list[dict]:
    """The forest as a list of trees of nested (feature, threshold, left, right) with the share of secrets at leaves.

    The model is written to the shared folder, which is the way to its leaves, and removed after it is read.
    """
    names = list(features(F.lit(""), F.lit(""), F.lit("")))
    where = f"{shared_dir(spark)}/forest-{uuid.uuid4().hex}"
    model.write().save(where)
    nodes: dict[tuple[int, int], dict] = {}
    for row in spark.read.parquet(f"{where}/data").select("treeID", "nodeData.*").collect():  # at most trees * 2^(depth + 1)
        nodes[row["treeID"], row["id"]] = row.asDict(recursive=True)
    removed(spark, where)

    def grown(tree: int, at: int) -> dict | float:
        node = nodes[tree, at]
        if node["leftChild"] < 0:
            return node["impurityStats"][1] / sum(node["impurityStats"])
        split = node["split"]
        return {"feature": names[split["featureIndex"]], "threshold": split["leftCategoriesOrThreshold"][0], "left": grown(tree, node["leftChild"]), "right": grown(tree, node["rightChild"])}

    return [grown(t, 0) for t in range(model.getNumTrees)]


def train_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> list[dict]:
    return read_forest(fit_forest(labelled, trees, depth, seed), labelled.sparkSession)


def forest_score(forest: list, named) -> Column:
    """The mean over trees of the share of secrets at the leaf that the features reach."""

    def walk(node) -> Column:
        if not isinstance(node, dict):
            return F.lit(float(node))
        return F.when(named[node["feature"]] <= node["threshold"], walk(node["left"])).otherwise(walk(node["right"]))

    total = walk(forest[0])
    for tree in forest[1:]:
        total = total + walk(tree)
    return total / len(forest)


def with_findings(docs: DataFrame, forest: list, name: str) -> DataFrame:
    """Adds an array of the (place, before, candidate, score) of every candidate, null if there is none; place counts from 1."""
    name = unused(docs, name)
    text, path = F.coalesce("text", F.lit("")), F.coalesce(F.col("source").cast("string"), F.lit(""))
    first, middle, last = MARKS
    marked = F.regexp_replace(F.translate(text, MARKS, "\n" * len(MARKS)), F.lit(CANDIDATE), F.lit(f"{first}$4{middle}$3{last}"))
    pieces = F.split(marked, first)  # what stands before the first find, then one for each find
    inside = lambda x: F.substring_index(x, last, 1)
    found = F.transform(pieces, lambda x, i: F.struct(i.alias("place"), F.substring_index(x, middle, 1).alias("before"), F.substring_index(inside(x), middle, -1).alias("candidate")))
    out = docs.withColumn(name, F.filter(found, lambda x: x["place"] > 0)).withColumn(name, F.when(F.size(name) > 0, F.col(name)))
    keep = lambda x: [x[k].alias(k) for k in ("place", "before", "candidate")]
    seen = F.transform(name, lambda x: F.struct(*keep(x), F.struct(*[c.alias(k) for k, c in features(x["candidate"], x["before"], path).items()]).alias("f")))
    return out.withColumn(name, F.transform(seen, lambda x: F.struct(*keep(x), forest_score(forest, x["f"]).alias("score"))))


def scan(docs: DataFrame, forest: list, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, place, before, secret, score) of every secret; place counts the candidates of the text from 1."""
    rows = with_findings(docs.select("doc_id", "text", "source"), forest, "found").where(F.col("found").isNotNull())
    rows = rows.select("doc_id", F.explode("found").alias("hit"))
    return rows.select("doc_id", "hit.place", "hit.before", F.col("hit.candidate").alias("secret"), "hit.score").where(F.col("score") >= threshold)


def redact(docs: DataFrame, forest: list, threshold: float = THRESHOLD) -> DataFrame:
    """The same documents with every secret replaced by MARK; n_chars, where there is one and a secret was found, follows."""
    name = unused(docs, "findings")
    rows = with_findings(docs, forest, name)
    secrets = F.transform(F.filter(name, lambda x: x["score"] >= threshold), lambda x: x["candidate"])
    rows = rows.withColumn(name, F.array_sort(F.array_distinct(secrets), lambda a, b: F.length(b) - F.length(a)))  # a secret may hold another
    word = lambda s: F.concat(F.lit(r"(?<![\p{L}\p{N}])\Q"), F.replace(s, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![\p{L}\p{N}])"))
    masked = lambda t, s: F.when(F.length(s) >= LONG_CHARS, F.replace(t, s, F.lit(MARK))).otherwise(F.regexp_replace(t, word(s), F.lit(MARK)))
    text = F.when(F.size(name) > 0, F.aggregate(name, F.col("text"), masked)).otherwise(F.col("text"))
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.size(name) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
