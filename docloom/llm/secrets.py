"""Secret findings with a random forest against false positives.

Candidates are runs of 16 or more key characters with a digit among them; values of 8 or more characters without white
space after a name such as password or token and = or :, in quotes or not; and passwords in URLs. A value that is just
such a run is one candidate; a longer one that holds runs is a candidate besides them. Each text is cut at its
candidates, of runs and of values by themselves, so the pieces between them give every candidate's offset and its
neighbouring words in one linear pass for each of the two. Columns describe each candidate: length, character classes and transitions between them, spread of characters, coverage by dictionary words,
path-like shape of the candidate and of the place it was found in, words and signs around it. A random forest of
fixed size, trained from labelled findings, scores them; findings under the threshold are marked as removed.

Labelled findings are a table (candidate, before, after, path, label). `labelled_findings` generates one from a fixed
seed; any table of that form can be given instead (at most MAX_TRAIN rows of it are used, those of the least hash).

Nothing is shuffled but the training rows. Defined results: null and empty texts have no candidate; repeated rows give
repeated findings; a null path counts as empty; other columns are ignored. DataFrame, SQL and MLlib functions only.
"""

from __future__ import annotations

import json
import random

from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CANDIDATE = r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}"
_RUN = r"(?=[A-Za-z+/_\-]*+[0-9])[A-Za-z0-9+/_\-]{16,}+={0,2}+"
_NAME = r"(?i:secret|token|passw(?:or)?d|pass|passphrase|pwd|(?:api|access|private|secret|signing|encryption)[_\-. ]?key|credentials?|auth)(?:[_\-][A-Za-z0-9_\-]{0,16}|[0-9]{0,3})[\"']?\s{0,4}(?::=|=>|[=:])\s{0,4}"
#: Ends of values without quotes: white space, quotes and brackets after closing signs, or a sign before the next name.
_END = r"(?=[,;&|][A-Za-z_][\w.\-]{0,60}[\"']?[=:]|[,;.)}\]]{0,3}(?:[\s\"'`<>]|\z))"
#: Lazy or possessive repeats of single characters only: they take linear time and no stack.
VALUE = (
    rf"(?<=[=:>]\s{{0,4}}[\"']?)(?![\s\"'=:>])(?!{_RUN}{_END})"
    rf"(?:(?<={_NAME}\")[^\s\"]{{8,}}+(?=\")|(?<={_NAME}')[^\s']{{8,}}+(?=')|(?<={_NAME}[\"']?)[^\s\"'`]{{8,}}?{_END})"
    rf"|(?<=:)(?!{_RUN}@)(?<=[A-Za-z]://[^\s/:@\"'<>]{{0,128}}:)[^\s/@\"'<>]{{3,}}+(?=@)"
)
MAX_TRAIN = 20_000
FINDING = "array<struct<candidate:string,before:string,after:string,path:string,label:int>>"
# Frequent English words and word parts that names and slugs are made of.
DICTIONARY = (
    "about after all and any app are back been before build can case class code com config data date day default dev docs "
    "down end error event file first for from get good group has have home html http image index info into item just key "
    "last like line link list local long made main make many master may menu model more name new news not number off one "
    "only order other out over page part people post product prod project public report same search service set should show "
    "site some start state style system table test text than that the their them then there these they this time title top "
    "two type under update use user value version very view want was way web week well what when where which will with work year you your"
)


def _coverage(column: str) -> Column:
    words = "|".join(sorted((w for w in DICTIONARY.split() if len(w) > 2), key=lambda w: (-len(w), w)))
    return 1 - F.length(F.regexp_replace(F.lower(column), words, "")) / F.length(column)


def features() -> dict[str, Column]:
    """Named columns over candidate, before, after and path."""
    c, b = F.col("candidate"), F.lower("before")
    count = lambda p, s=c: F.regexp_count(s, F.lit(p)).cast("double")
    has = lambda s, p: F.regexp_like(s, F.lit(p)).cast("double")
    letters = F.array_distinct(F.split(c, ""))
    share = lambda x: (F.length(c) - F.length(F.replace(c, x, F.lit("")))) / F.length(c)
    spread = F.aggregate(F.filter(letters, lambda x: x != ""), F.lit(0.0), lambda s, x: s - share(x) * F.log2(share(x)))
    return {
        "length": F.length(c).cast("double"),
        "digits": count("[0-9]") / F.length(c),
        "upper": count("[A-Z]") / F.length(c),
        "signs": count(r"[+/_\-=]") / F.length(c),
        "transitions": count("(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])") / F.length(c),
        "repeats": count(r"(.)\1") / F.length(c),
        "longest_digits": F.coalesce(F.array_max(F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), 0), lambda x: F.length(x))), F.lit(0)).cast("double"),
        "spread": spread,
        "hex": has(c, "^[0-9a-f]+$"),
        "uuid": has(c, "^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-"),
        "covered": _coverage("candidate"),
        "slashes": count("/"),
        "dashes": count("-"),
        "prefix": has(c, "^(AKIA|ASIA|gh[pousr]_|sk[_-]|pk_|xox|eyJ|glpat-|AIza)"),
        "path_test": has(F.lower("path"), "test|example|fixture|sample|mock|vendor|lock"),
        "path_config": has(F.lower("path"), r"\.env|config|secret|credential|settings|\.pem|\.ya?ml|\.ini"),
        "assigned": has(b, r"""[=:]\s*["']?$"""),
        "quoted": has(b, "[\"']$"),
        "names_secret": has(b, r"(secret|token|passw(or)?d|pwd|api.?key|access.?key|private.?key|credential|auth|bearer)[^a-z]{0,6}[\"']?\s*$"),
        "names_secret_near": has(b, r"secret|token|passw|api.?key|credential|bearer"),
        "names_hash": has(b, r"commit|sha-?[0-9]*|md5|checksum|digest|hash|etag|integrity|revision|uuid|guid|version|build"),
        "marks": count(r"[^A-Za-z0-9+/_\-=]") / F.length(c),
        "named": has(F.col("before"), _NAME + "[\"']?$"),
        "url_password": has(b, r"[a-z]://[^\s/:@]*:$"),
        "word": has(c, "^([A-Z]?[a-z]+|[A-Z]+)[?!.,;:]*$"),
        "code": has(c, r"^[$%{<\[*(&@]|[(\[{<]|\w\.[A-Za-z_]\w*\.|^[a-z_]+\.[A-Za-z_]+$|://"),
        "placeholder": has(F.lower(c), r"your|example|change_?me|placeholder|redacted|x{4}|\*{4}|null|none|undefined|required|optional"),
        "url_before": has(b, r"(https?://|www\.)\S*$"),
        "word_after": has(F.lower("after"), r"^[\"']?[,;.)\]]?\s*[a-z]{2,}"),
        "dot_after": has(F.col("after"), r"^\.[a-z]{2,4}\b"),
    }


def labelled_findings(spark: SparkSession, rows: int = 3000, seed: int = 5) -> DataFrame:
    """Generated findings with labels: keys in use, and look-alikes (hashes, identifiers, slugs, numbers, samples)."""
    rng = random.Random(seed)
    pick = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    hexa, b64 = num + "abcdef", low + up + num + "+/"
    words = DICTIONARY.split() + ["ther", "eres", "onan", "ing", "tion", "ble", "eau", "ment", "keit", "ung", "ción", "mente"]

    def text(n: int) -> str:
        return " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))

    out = []

    def add(candidate: str, before: str, quote: str, path: str, real: int, after: str = "") -> None:
        after += rng.choice((quote, quote + " ", quote + ", ", quote + "### ")) + text(3)
        out.append({"candidate": candidate, "before": before[-48:], "after": after[:24], "path": path, "label": real})

    for k in range(rows):
        real = k % 2
        quote = rng.choice(('"', "'", "", ""))
        if real:
            name = rng.choice("token secret password api_key apikey access_key auth_token secret_key client_secret private_key credentials pwd".split())
            name = rng.choice((name, name.upper(), f"my_{name}", f"{rng.choice(words)}_{name}"))
            candidate = rng.choice((
                lambda: pick(hexa, rng.choice((32, 40, 40, 64))), lambda: pick(b64, rng.randint(20, 64)), lambda: "AKIA" + pick(up + num, 16),
                lambda: "ghp_" + pick(low + up + num, 36), lambda: "sk_" + pick(low + num, 32), lambda: pick(low + up + num, rng.randint(16, 40)),
            ))()
            before = f"{text(4)} {name}{rng.choice((' = ', '=', ': ', ':', ' := '))}{quote}"
            if candidate[:4] in ("AKIA", "ghp_") and rng.random() < 0.5:
                before = text(5) + rng.choice((" ", " (", ": "))
            path = rng.choice(("", "", ".env", "config/settings.yml", "src/main.py", f"src{rng.randint(0, 20)}"))
        else:
            candidate, before = rng.choice((
                lambda: (pick(hexa, 40), f"{text(4)} {rng.choice(('commit ', 'sha1: ', 'revision = ', 'commit: '))}"),
                lambda: (pick(hexa, rng.choice((32, 64))), f"{text(4)} {rng.choice(('md5: ', 'checksum=', 'sha256-', 'hash: ', 'digest '))}"),
                lambda: ("-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), f"{text(4)} {rng.choice(('id=', 'uuid: ', 'guid ', ''))}"),
                lambda: (rng.choice(("-", "_", "/")).join(rng.choice(words) for _ in range(rng.randint(3, 7))).replace("ó", "o") + rng.choice(("-", "_", "")) + pick(num, rng.randint(1, 4)), text(5) + " "),
                lambda: (pick(num, rng.randint(16, 22)), text(5) + rng.choice((" ", ": ", " no "))),
                lambda: ("/".join(rng.choice(words) for _ in range(4)) + "/" + pick(num, 4), f"{text(3)} https://example.com"),
                lambda: (rng.choice("xyzaA01") * rng.randint(16, 30) + "1", f"{text(3)} token = {quote}"),
                lambda: (f"your_{rng.choice(('api', 'secret', 'token'))}_key_here_{pick(num, 2)}", f"{text(3)} {rng.choice(('token', 'secret', 'api_key'))} = {quote}"),
                lambda: ("abcdefghijklmnop1234567890"[: rng.randint(18, 26)], f"{text(3)} password: {quote}"),
                lambda: (pick(low, rng.randint(15, 24)) + pick(num, 1), text(6) + " "),
            ))()
            path = rng.choice(("", "", "package-lock.json", "tests/test_api.py", "docs/example.md", f"src{rng.randint(0, 20)}"))
        if len(candidate) >= 16 and any(ch in num for ch in candidate):
            add(candidate, before, quote, path, real)
    symbols = low + up + num + "!.&$%*#-_?^~"
    for k in range(rows):  # values after a name, and passwords in URLs
        real = k % 2
        quote = rng.choice(('"', "'", "", ""))
        name = rng.choice("token secret password passwd pass pwd passphrase api_key access_key auth_token client_secret".split())
        name = rng.choice((name, name.upper(), name.capitalize(), f"db_{name}", f"DB_{name.upper()}", f"{rng.choice(words)}_{name}"))
        before = f"{text(4)} {name}{rng.choice((' = ', '=', ': ', ':', ' := '))}{quote}"
        path = rng.choice(("", "", ".env", "config/settings.yml", "src/main.py", "tests/test_api.py", "docs/example.md", f"src{rng.randint(0, 20)}"))
        if real:
            mixed = lambda: pick(low + up, 3) + pick(num, 1) + pick(symbols, rng.randint(4, 16))
            worded = lambda: "".join(rng.choice(words).replace("o", rng.choice("o0")) for _ in range(3))[: rng.randint(7, 14)].ljust(7, "k") + pick(num, rng.randint(1, 4)) + rng.choice(("", "", "!", "$"))
            candidate = rng.choice((
                mixed, mixed, worded, worded, lambda: pick(low + up, rng.randint(10, 32)), lambda: pick(low, rng.randint(12, 32)),
                lambda: rng.choice("-_.").join(rng.choice(words) for _ in range(rng.randint(4, 6))).replace("ó", "o"), lambda: pick(low + num, rng.randint(8, 15)),
                lambda: pick(low + up, rng.randint(2, 5)).capitalize() + pick(num, 1) + pick(low, 3) + pick(num, 1) + pick(low, 3) + rng.choice("&!$.") + pick(num, 1),
            ))()
            after = ""
            if k % 8 == 1:
                before, quote, after = f"{text(3)} {rng.choice(('postgres', 'mysql', 'https', 'redis', 'amqp'))}://{rng.choice(('user', 'admin', 'root', rng.choice(words)))}:", "", "@" + rng.choice(("host", "localhost", "db.internal")) + rng.choice((":5432/", "/", ""))
            add(candidate, before, quote, path, 1, after)
        else:
            var = rng.choice(words).replace("ó", "o")
            candidate = rng.choice((
                lambda: f"${{{name.upper()}}}", lambda: f"os.environ[{name.upper()}]", lambda: f"process.env.{name.upper()}", lambda: f"get_{name}()", lambda: f"config.{var}_{name}", lambda: f"<your-{name}>",
                lambda: "*" * rng.randint(8, 16), lambda: "x" * rng.randint(8, 16), lambda: f"{{{{ {var} }}}}".replace(" ", "") + "_here", lambda: f"self.{name}", lambda: f"your_{name}", lambda: "changeme_" + var,
                lambda: rng.choice("required undefined disabled forgotten something everything different important password placeholder optional available customer management information together".split()),
                lambda: rng.choice("Required Undefined Disabled Forgotten Something Everything Different Important Available Management Information Together".split()) + rng.choice(("", ".", "?", "!")),
                lambda: f"https://example.com/{var}", lambda: f"request.{var}.{name}", lambda: f"String(required,{var})",
            ))()
            if k % 8 == 0:
                candidate, before, quote = rng.choice(("password", "<password>", "${PASSWORD}", "$PASSWORD", "********", "{password}", "PASSWORD", "xxxxxxxx")), f"{text(3)} {rng.choice(('postgres', 'mysql', 'https', 'redis'))}://user:", ""
                add(candidate, before, quote, path, 0, "@host")
            elif len(candidate) >= 8:
                add(candidate, before, quote, path, 0)
    return spark.sql(f"SELECT inline(from_json(:findings, '{FINDING}'))", args={"findings": json.dumps(out)})


def train(findings: DataFrame, trees: int = 24, depth: int = 7, seed: int = 3) -> PipelineModel:
    """A forest of fixed size from labelled findings."""
    some = findings.where("label in (0, 1) and candidate is not null").orderBy(F.xxhash64("candidate", "before")).limit(MAX_TRAIN)
    names = features()
    assembler = VectorAssembler(inputCols=list(names), outputCol="_features")
    table = assembler.transform(_described(some).select(*names, F.col("label").cast("double").alias("_label"))).repartition(2)
    forest = RandomForestClassifier(featuresCol="_features", labelCol="_label", numTrees=trees, maxDepth=depth, seed=seed, rawPredictionCol="_raw", probabilityCol="_p", predictionCol="_y")
    return PipelineModel([assembler, forest.fit(table)])


def _described(findings: DataFrame) -> DataFrame:
    filled = findings.withColumns({k: F.coalesce(F.col(k), F.lit("")) for k in ("before", "after", "path")})
    return filled.withColumns({k: F.coalesce(c, F.lit(0.0)) for k, c in features().items()})


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str | None) -> DataFrame:
    """id, start, end (code points, end exclusive), candidate, before, after and path of every candidate."""
    text = F.col(text_col).cast("string")
    path = F.col(path_col).cast("string") if path_col else F.lit("")
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), path.alias("path"))
    return _matches(rows, CANDIDATE).unionByName(_matches(rows, VALUE))


def _matches(rows: DataFrame, pattern: str) -> DataFrame:
    held = rows.where(F.regexp_like("text", F.lit(pattern)))
    cut = held.select("id", "path", F.regexp_extract_all("text", F.lit(pattern), 0).alias("found"), F.split("text", pattern, -1).alias("pieces"))
    step = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
    walked = F.aggregate(
        F.zip_with("found", F.slice("pieces", 1, F.size("found")), lambda f, p: F.struct(F.length(p).alias("gap"), F.length(f).alias("n"))),
        step,
        lambda s, x: F.struct((s["at"] + x["gap"] + x["n"]).alias("at"), F.concat(s["starts"], F.array(s["at"] + x["gap"])).alias("starts")),
    )["starts"]
    each = cut.withColumn("starts", walked).select("id", "path", "pieces", "starts", F.posexplode("found").alias("k", "candidate"))
    start = F.get("starts", F.col("k")).cast("bigint")
    return each.select(
        "id", "path", start.alias("start"), (start + F.length("candidate")).alias("end"), "candidate",
        F.right(F.get("pieces", F.col("k")), F.lit(48)).alias("before"), F.left(F.get("pieces", F.col("k") + 1), F.lit(24)).alias("after"),
    )


def scan(docs: DataFrame, model: PipelineModel, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = None, threshold: float = 0.5) -> DataFrame:
    """id, start, end, score and kept of every candidate; kept is false for those that the forest removes."""
    described = _described(candidates(docs, id_col, text_col, path_col))
    scored = model.transform(described).withColumn("score", vector_to_array("_p")[1])
    return scored.select(F.col("id").alias(id_col), "start", "end", "candidate", F.round("score", 6).alias("score"), (F.col("score") >= threshold).alias("kept"))
