"""Secret scans: candidate strings, features of each, and a random forest that drops the false findings.

The forest is trained on labelled findings (``labelled_findings`` makes some by rule; any table of that form will do)
and compiled into one SQL expression, so scanning, scoring and redaction are native DataFrame expressions inside the
row: no text is shuffled.  The dictionary is the corpus's own commonest words.
"""

from __future__ import annotations

from functools import cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .trees import Trees, fit_forest

#: What an assigned value may be made of, and the sign, blanks and quote before it.
SIGN, VALUE = r"[:=][ \t]{0,2}[\"']?", r"[!-~&&[^\"'<>,;()]]{6,128}"
#: An assigned value with its sign, or a run of key characters with its padding.
CANDIDATE = SIGN + r"(?![/=:])" + VALUE + r"|[A-Za-z0-9_+/-]{16,}={0,2}"
#: Words near secrets and words near other long strings (fixed lists).
NEAR = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|passphrase|api|key|auth|bearer|credential|private|access|login)"
NEAR_NOT = r"(?i)(?:commit|sha(?:1|256|512)?|md5|digest|checksum|uuid|guid|version|build|card|order|phone|isbn|image|etag|revision|hash|integrity)"
#: Marks of a value that stands for another (fixed list).
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|change.?me|your[_-]|_here|xxxx|\$\{|\{\{|environ|getenv|redacted|required|undefined|none|null|true|false"
#: Words that the dictionary holds whatever the corpus says (fixed list).
BASE_WORDS = "user name file image upload content static assets version index article report document release update window python number model change insert value page data http password secret token login admin test"
FEATURES = [
    "length", "digit_share", "upper_share", "lower_share", "symbol_share", "transitions", "distinct_share", "hex", "all_digits",
    "dictionary", "longest_word", "path", "slashes", "near", "near_not", "assigned", "quoted", "prefix", "names", "placeholder", "url_login", "lower_only",
]
CONTEXT = 32
#: Most words of the dictionary.
DICTIONARY_WORDS = 2000


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY_WORDS) -> list[str]:
    """The commonest words of 4 to 20 letters over all documents, at most ``most`` (ties: alphabetical)."""
    words = F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^a-z]+", -1)
    counts = docs.select(F.explode(words).alias("w")).where(F.length("w").between(4, 20)).groupBy("w").agg(F.count(F.lit(1)).alias("n")).where("n > 2")
    return [r["w"] for r in counts.orderBy(F.col("n").desc(), "w").limit(most).collect()]


def features(c: Column, left: Column, right: Column, words: tuple[str, ...] = ()) -> Column:
    """The feature struct of a candidate between its left and right context; ``words`` add to the dictionary."""
    n = F.length(c).cast("double")

    def count(pattern: str) -> Column:
        return F.regexp_count(c, F.lit(pattern)).cast("double")

    def flag(cond: Column) -> Column:
        return F.when(cond, 1.0).otherwise(0.0)

    known = F.split(F.lit(" ".join(sorted({*BASE_WORDS.split(), *words}))), " ")
    parts = F.regexp_extract_all(c, F.lit("[A-Z]?[a-z]+|[A-Z]+"), F.lit(0))
    covered = F.aggregate(F.filter(parts, lambda w: F.array_contains(known, F.lower(w))), F.lit(0), lambda s, w: s + F.length(w))
    longest = F.coalesce(F.array_max(F.transform(parts, lambda w: F.length(w))), F.lit(0))
    borders = r"(?<=[a-z])(?=[^a-z])|(?<=[A-Z])(?=[^A-Za-z])|(?<=[0-9])(?=[^0-9])|(?<=[^A-Za-z0-9])(?=[A-Za-z0-9])"
    values = [
        n, count("[0-9]") / n, count("[A-Z]") / n, count("[a-z]") / n, count("[^A-Za-z0-9]") / n, count(borders) / n,
        F.size(F.array_distinct(F.split(c, ""))).cast("double") / F.least(n, F.lit(40.0)),
        flag(F.regexp_like(c, F.lit("^(?:[0-9a-f]+|[0-9A-F]+)$"))), flag(F.regexp_like(c, F.lit("^[^A-Za-z]+$"))),
        covered.cast("double") / n, longest.cast("double") / n,
        flag(F.regexp_like(left, F.lit(r"(?::/|[./~\\])$")) | F.regexp_like(right, F.lit(r"^\.[a-z]{2,4}\b"))),
        count("/"), flag(F.regexp_like(left, F.lit(NEAR))), flag(F.regexp_like(left, F.lit(NEAR_NOT))),
        flag(F.regexp_like(left, F.lit(r"[=:]\s*[\"']?$"))), flag(F.regexp_like(left, F.lit("[\"']$")) & F.regexp_like(right, F.lit("^[\"']"))),
        flag(F.regexp_like(c, F.lit(r"^(?:AKIA|ASIA|gh[pousr]_|sk_live|rk_live|xox|eyJ|glpat-)"))),
        flag(F.regexp_like(right, F.lit(r"^[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?[A-Za-z0-9_+/-]"))),
        flag(F.regexp_like(c, F.lit(PLACEHOLDER))), flag(F.regexp_like(left, F.lit(r"://[^\s/:@]*:$")) & F.regexp_like(right, F.lit("^@"))),
        flag(F.regexp_like(c, F.lit(r"^[A-Z]?[a-z]+[.!?]?$"))),
    ]
    return F.struct(*[v.alias(name) for v, name in zip(values, FEATURES)])


def labelled_findings(spark: SparkSession, rows: int = 9000) -> DataFrame:
    """Findings with labels, made by rule from the row number: id, c, left, right, label.

    Label 1: key material and passwords behind a name and a sign, keys of known prefixes, logins in URLs.  Label 0:
    checksums and commit ids, uuids, card and order numbers, paths and URLs, identifiers, placeholders, prose after a
    colon and plain long words.
    """
    h, h64 = "sha1(cast(id as string))", "sha2(cast(id as string), 256)"
    b = "regexp_replace(base64(unhex(sha2(cast(id as string), 256))), '[+/=]', 'k')"
    letters = "translate(" + b + ", '0123456789', 'qWeRtYuIoP')"

    def one_of(values: list[str], by: int) -> str:
        listed = ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)
        return f"element_at(array({listed}), cast(id div {by} % {len(values)} + 1 as int))"

    word = one_of(["the", "set", "export", "const", "with", "my", "new", "and", "use", "for", "our", "old"], 3)
    name = one_of(["token", "api_key", "secret", "password", "auth_token", "access key", "private_key", "client_secret", "DB_PASSWORD", "pwd", "apiKey", "SERVICE_TOKEN"], 5)
    sign = one_of(["=", " = ", ": ", ':"', '="', "='", ' = "', ': "'], 7)
    end = one_of(["", " ", " and", "\\n", ". "], 11)
    close = f"concat(if({sign} like '%\"', '\"', if({sign} like '%\\'', '\\'', '')), {end})"
    named = f"concat({word}, ' ', {name}, {sign})"
    digits = "lpad(cast(abs(xxhash64(id)) % 10000000000000000 as string), 16, '4')"
    plain = one_of(["forgotten", "something", "required", "Remember", "nobody", "anything", "mandatory", "Invalid", "expired.", "unknown"], 13)
    cases = [
        (1, f"if(id % 3 = 0, upper({h}), {h})", named, close),
        (1, f"substr({h64}, 1, element_at(array(20, 32, 48, 64), cast(id div 17 % 4 + 1 as int)))", named, close),
        (1, f"substr({b}, 1, cast(18 + id div 9 % 24 as int))", named, close),
        (1, f"concat('AKIA', upper(substr({b}, 1, 16)))", f"concat({word}, ' ')", end),
        (1, f"concat({one_of(['ghp_', 'gho_', 'sk_live_', 'xoxb-', 'glpat-'], 19)}, substr({b}, 1, 36))", f"concat({word}, {one_of([' ', ' = ', ': '], 23)})", end),
        (1, f"concat(substr({b}, 1, 4), {one_of(['!', '#', '$', '@', '%', '*', '.'], 3)}, substr({b}, 6, cast(3 + id % 6 as int)))", named, close),
        (1, f"concat({one_of(['hunter', 'Winter', 'dragon', 'Summer', 'qwerty', 'Tr0ub4dor', 'sunshine'], 3)}, cast(id % 997 as string), {one_of(['!', '', '#', '?x', '_'], 29)})", f"concat({word}, ' ', {one_of(['password', 'passwd', 'pwd', 'DB_PASSWORD', 'passphrase', 'secret'], 5)}, {sign})", close),
        (1, f"substr({letters}, 1, cast(16 + id % 20 as int))", named, close),
        (1, f"if(id % 2 = 0, substr({b}, 1, 12), concat('pass', cast(id % 9973 as string), '!'))", f"concat({one_of(['postgres://', 'https://', 'redis://', 'amqp://'], 3)}, {one_of(['admin', 'svc', 'root', ''], 7)}, ':')", f"concat('@', {one_of(['db.internal/prod', '10.0.0.4:5432', 'host', 'example.org/x'], 5)})"),
        (0, f"if(id % 3 = 0, {h64}, {h})", f"concat({word}, ' ', {one_of(['commit ', 'sha256: ', 'md5 = ', 'etag: \"', 'checksum=', 'revision ', 'digest: ', 'integrity=\"'], 5)})", end),
        (0, h, f"concat({word}, ' ')", end),
        (0, f"concat(substr({h},1,8),'-',substr({h},9,4),'-',substr({h},13,4),'-',substr({h},17,4),'-',substr({h},21,12))", f"concat({word}, {one_of([' ', ' id: ', ' uuid = ', ' request '], 5)})", end),
        (0, digits, f"concat({word}, {one_of([' ', ' card ', ' order: ', ' key = '], 5)})", end),
        (0, "concat('/wp-content/uploads/', cast(2000 + id % 25 as string), '/image-', cast(id as string))", "'https://www.example.com'", "'.png'"),
        (0, f"concat('assets/', substr({h}, 1, 20))", "'https://cdn.example.com/'", "'.js'"),
        (0, f"concat({one_of(['user_name_field_', 'MAX_RETRY_COUNT_', 'handleUserLogin', 'api_key_rotation_', 'access_token_name_', 'parseDocumentIndex'], 3)}, cast(id % 100 as string))", f"concat({word}, ' ')", f"concat({one_of([' = ', '=', '(', ' ', ': '], 7)}, substr({h}, 1, 30))"),
        (0, f"{one_of(['YOUR_API_KEY_HERE', 'changeme', '${DB_PASSWORD}', 'os.environ', 'example_token_1', 'xxxxxxxxxxxx', 'undefined', 'your-secret-here', 'PLACEHOLDER_0', 'getenv.TOKEN', '{{secret}}'], 3)}", named, close),
        (0, plain, f"concat({word}, ' ', {name}, {one_of([': ', ' = ', ': \"'], 5)})", end),
        (0, f"{one_of(['Bearer', 'Digest', 'Negotiate', 'Basic64'], 3)}", f"concat({word}, ' ', {one_of(['Authorization: ', 'auth: ', 'Proxy-Authorization: '], 7)})", f"concat(' ', substr({b}, 1, 24))"),
        (0, "cast(100000 + id * 7919 % 9900000 as string)", f"concat({word}, ' ', {one_of(['keys', 'tokens', 'key', 'access'], 3)}, {one_of([': ', ' = '], 5)})", end),
        (0, "repeat(cast(id % 10 as string), cast(16 + id % 9 as int))", named, end),
        (0, f"concat({one_of(['internationalization', 'Donaudampfschifffahrt', 'characterizationOf', 'thunderstormWarning', 'counterrevolutionary'], 3)}, if(id % 2 = 0, '', cast(id % 10 as string)))", f"concat({word}, ' ')", end),
        (0, "concat('2021-03-', lpad(cast(id % 28 + 1 as string), 2, '0'), '-report-', cast(id as string))", "'see '", "'.pdf'"),
    ]
    pick = lambda j: f"CASE id % {len(cases)} " + " ".join(f"WHEN {i} THEN {c[j]}" for i, c in enumerate(cases)) + " END"
    return spark.range(rows).select("id", F.expr(pick(1)).alias("c"), F.expr(pick(2)).alias("left"), F.expr(pick(3)).alias("right"), F.expr(pick(0)).alias("label"))


def train(findings: DataFrame, most: int = 20_000, words: tuple[str, ...] = ()) -> Trees:
    """A forest from labelled findings (c, left, right, label); at most ``most`` rows come to the driver."""
    x = findings.select(features(F.col("c"), F.col("left"), F.col("right"), words).alias("f"), "label", "c", "left")
    rows = x.orderBy(F.xxhash64("c", "left"), "c", "left").limit(most).select("f.*", "label").collect()
    data = np.array([[float(v) for v in r] for r in rows])
    return fit_forest(data[:, :-1], data[:, -1], count=21, depth=7)


def measured(findings: DataFrame, model: Trees, words: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """One row: how many findings are labelled true and false, and the precision and recall of the model on them."""
    score = findings.select("label", features(F.col("c"), F.col("left"), F.col("right"), words).alias("f"))
    score = score.select("label", (F.round(F.expr(model.sql([f"f.{n}" for n in FEATURES])), 9) >= threshold).alias("said"))
    hit = F.sum(F.when(F.col("said") & (F.col("label") == 1), 1).otherwise(0))
    return score.agg(
        F.sum("label").alias("true_findings"), F.sum(1 - F.col("label")).alias("false_findings"),
        (hit / F.sum(F.col("said").cast("int"))).alias("precision"), (hit / F.sum("label")).alias("recall"),
    )


@cache
def default_model(spark: SparkSession, words: tuple[str, ...] = ()) -> Trees:
    return train(labelled_findings(spark), words=words)


EMPTY = "slice(array(named_struct('start',0,'length',0,'candidate','','score',0D,'is_secret',false)),1,0)"


def scan(docs: DataFrame, model: Trees | None = None, text_col: str = "text", threshold: float = 0.5, words: tuple[str, ...] = ()) -> DataFrame:
    """All rows of ``docs`` plus ``findings``: array of (start, length, candidate, score, is_secret), by position.

    Candidates are: runs of 16 or more key characters with a digit or a change from lower to upper case, if not
    all digits and signs; and values of 6 or more characters behind ``:`` or ``=`` that have a word of NEAR in the
    32 characters before them, or stand between the colon and the at sign of a URL.  ``words`` must be those that the
    model was trained with.  ``start`` counts characters from 0.  Null and empty texts have no findings; a text of
    any length is scanned whole; repeats are each a finding.  An input column called findings is replaced.
    """
    model = model or default_model(docs.sparkSession, words)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rough = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    worth = r"^[:=]|^(?=.*[0-9])(?=.*[A-Za-z])|[a-z][A-Z]"
    some = F.exists(rough, lambda m: F.regexp_like(m, F.lit(worth)))
    out = docs.withColumn("__m", F.when(some, rough)).withColumn("__p", F.when(F.col("__m").isNotNull(), F.split(text, CANDIDATE, -1)))
    # running starts: the end of each gap, in characters
    starts = F.aggregate(
        F.arrays_zip(F.slice("__p", F.lit(1), F.size("__m")), "__m"),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")),
        lambda s, z: F.struct(
            (s["at"] + F.length(z["0"]) + F.length(z["__m"])).alias("at"), F.array_append(s["all"], s["at"] + F.length(z["0"])).alias("all")
        ),
        lambda s: s["all"],
    )
    out = out.withColumn("__s", starts)

    def around(i: Column, gaps: tuple[int, ...]) -> Column:
        """The text of gaps next to match i with the matches between them; a match has 7 characters at least."""
        parts = [F.coalesce(F.get(c, i + j), F.lit("")) for j in gaps for c in (("__p", "__m") if j < gaps[-1] else ("__p",))]
        return F.concat(*parts)

    def placed(m: Column, i: Column) -> Column:
        """The candidate of a match: without its sign, and without what follows the at sign of a login."""
        sign = F.regexp_extract(m, "^(?:" + SIGN + ")?", 0)
        login = F.regexp_extract(m, r"^:([^\s@/]{1,128})@", 1)
        before = F.right(around(i, tuple(range(-5, 1))), F.lit(CONTEXT))
        in_url = (login != "") & F.regexp_like(before, F.lit(r"://[^\s/:@]*$"))
        c = F.when(in_url, login).otherwise(F.substring(m, F.length(sign) + 1, F.lit(2147483647)))
        # a full stop, colon or question mark at the end of an assigned value belongs to the sentence
        c = F.when(~in_url & (sign != ""), F.regexp_replace(c, r"(?<=[A-Za-z0-9])[.:?]$", "")).otherwise(c)
        rest = F.substring(m, F.length(sign) + F.length(c) + 1, F.lit(2147483647))
        return F.struct(
            (F.get("__s", i) + F.length(sign)).alias("start"), F.length(c).alias("length"), c.alias("candidate"), (sign != "").alias("signed"), in_url.alias("in_url"),
            F.right(F.concat(before, sign), F.lit(CONTEXT)).alias("left"), F.left(F.concat(rest, around(i, tuple(range(1, 7)))), F.lit(CONTEXT)).alias("right"),
        )

    out = out.withColumn("__c", F.transform(F.filter(F.transform("__m", lambda m, i: F.struct(m.alias("m"), i.alias("i"))), lambda z: F.regexp_like(z["m"], F.lit(worth))), lambda z: placed(z["m"], z["i"])))
    key = lambda x: F.regexp_like(x["candidate"], F.lit(r"^[A-Za-z0-9_+/-]{16,}={0,2}$")) & F.regexp_like(x["candidate"], F.lit(r"^(?=.*[0-9])(?=.*[A-Za-z])|[a-z][A-Z]"))
    out = out.withColumn("__c", F.filter("__c", lambda x: key(x) | x["in_url"] | (x["signed"] & (x["length"] >= 6) & F.regexp_like(x["left"], F.lit(NEAR)))))
    out = out.withColumn("__f", F.transform("__c", lambda x: x.withField("f", features(x["candidate"], x["left"], x["right"], words))))
    score = model.sql([f"x.f.{name}" for name in FEATURES])
    scored = F.expr(f"transform(__f, x -> named_struct('start', x.start, 'length', x.length, 'candidate', x.candidate, 'score', round({score}, 9)))")
    out = out.withColumn("__g", scored)
    found = F.transform("__g", lambda x: x.withField("is_secret", x["score"] >= threshold))
    return out.withColumn("findings", F.coalesce(found, F.expr(EMPTY))).drop("__m", "__p", "__s", "__c", "__f", "__g")


def redact(docs: DataFrame, model: Trees | None = None, text_col: str = "text", mark: str = "[SECRET]", words: tuple[str, ...] = ()) -> DataFrame:
    """``docs`` with every finding that the forest calls a secret replaced by ``mark``; other texts unchanged.

    Null and empty texts stay as they are; rows, their number and all other columns stay, but for an input column
    called findings, which is dropped.
    """
    out = scan(docs, model, text_col, words=words)
    ends = F.struct(F.lit(1).alias("at"), F.lit("").alias("text"))
    cut = F.aggregate(
        F.filter("findings", lambda f: f["is_secret"]),
        ends,
        lambda s, f: F.struct(
            (f["start"] + f["length"] + 1).alias("at"),
            F.concat(s["text"], F.substring(F.col(text_col), s["at"], f["start"] + 1 - s["at"]), F.lit(mark)).alias("text"),
        ),
        lambda s: F.concat(s["text"], F.substring(F.col(text_col), s["at"], F.lit(2147483647))),
    )
    return out.withColumn(text_col, F.when(F.exists("findings", lambda f: f["is_secret"]), cut).otherwise(F.col(text_col))).drop("findings")
