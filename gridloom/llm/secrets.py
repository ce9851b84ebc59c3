"""Secret scans in SQL: candidates by pattern, false positives removed by a random forest."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import column
from gridloom.llm.forest import Tree, random_forest

#: A private key block of any length; its body holds no dash, but for header lines.
_KEY_BLOCK = (
    r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:(?:\s|\\[nr]){0,4}[A-Za-z-]{1,20}: [^\r\n\\]{0,200}){0,8}+[^-]*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
)
#: A run of 16 token characters or more with a digit among them, and what pads it.
_TOKEN = r"(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*+[0-9])[A-Za-z0-9_+/-]{16,}+={0,2}+"
_NOT = r"\s\"'`,;<>(){}\[\]"
#: A word that names a secret and what stands between it and its value; and the same in a URL.
_NAMED = (
    r"(?i:passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|auth|credential|private[_ -]?key|signing[_ -]?key)"
    r"[\w-]{0,20}[\"'`\])]{0,2}[ \t]{0,2}(?:=>|:=|[=:])[ \t]{0,2}(?:(?i:bearer|basic|token)[ \t]{1,2})?[\"'`]?"
)
_IN_URL = r"://[^\s/:@\"'<>]{1,60}:"
#: After such a name any value of six characters or more will do, with a digit or without.
CANDIDATE = (
    rf"{_NAMED}(?:{_KEY_BLOCK}|{_TOKEN}(?![^{_NOT}]{{0,3}}[A-Za-z0-9])|[^{_NOT}]{{5,}}[^{_NOT}.!?:])"
    rf"|{_IN_URL}[^\s/@\"'<>]{{3,}}(?=@)|{_KEY_BLOCK}|{_TOKEN}"
)
#: What precedes the value within a candidate's match.
LEAD = rf"^(?:{_NAMED}|{_IN_URL})"
#: Formats that some issuers give their keys.
ISSUED = (
    r"^(?:-----BEGIN|(?:AKIA|ASIA)[0-9A-Z]{16}$|gh[pousr]_[A-Za-z0-9]{30,}|github_pat_|glpat-|xox[abprs]-"
    r"|sk_live_|sk-[A-Za-z0-9]{20}|AIza[0-9A-Za-z_-]{35}$|npm_[A-Za-z0-9]{36}$|eyJ[A-Za-z0-9_-]{10,})"
)
#: Words beside a value that name a secret, and such as name something harmless.
NAMES = r"(?i)(?:token|secret|passw|passwd|pwd|api[_ -]?key|access[_ -]?key|auth|credential|private|bearer|signing)[\w -]{0,20}[\"']?\s*(?:[=:]|=>|is)?\s*[\"']?$|://[^\s/:@]{1,60}:$"
HARMLESS = r"(?i)(?:sha\d*|md5|commit|checksum|digest|uuid|guid|revision|hash|example|sample|dummy|placeholder|phone|tel|card|iban|isbn|order|invoice|ref|version|build)\W{0,4}\w{0,10}\W{0,4}$"
#: Dictionary of the coverage feature.
DICTIONARY = (
    "account|admin|assets|backup|build|cache|change|class|client|cloud|code|config|content|data|default|demo|dist|docs|"
    "download|dummy|example|file|first|image|index|insert|item|library|local|mail|main|module|name|node|number|page|"
    "placeholder|private|product|project|public|release|report|sample|script|server|service|session|source|static|"
    "system|table|test|this|update|upload|user|value|version|your|word|xxxx|0000|1234|abcd|"
    "password|passwd|secret|token|auth|bearer|required|optional|string|none|null|true|false|undefined|changeme|change|"
    "hidden|redacted|enter|here|getenv|environ|process|self|request|response|type|field|input|must|with|from|\\*\\*\\*"
)
FEATURES = (
    "length", "digits", "upper", "symbols", "hex", "distinct", "transitions", "runs", "coverage",
    "path", "named", "harmless", "quoted", "assigned", "issued", "marks", "letters",
)


def _share(value: Column, kept: str) -> Column:
    dropped = f"[{kept[1:]}]" if kept.startswith("^") else f"[^{kept}]"
    return F.length(F.regexp_replace(value, dropped, "")) / F.length(value)


def _features(value: Column, before: Column, after: Column) -> Column:
    """Length, character transitions, dictionary coverage, path and neighbouring words of a candidate."""
    n = F.length(value)
    whole = F.length(value).cast("double")
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    count = lambda pattern: F.size(F.split(value, pattern, -1)) - 1
    turns = r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])|(?<=[0-9A-Za-z])(?=[_+/=-])"
    return F.struct(
        whole.alias("length"),
        _share(value, "0-9").alias("digits"),
        _share(value, "A-Z").alias("upper"),
        _share(value, "_+/=-").alias("symbols"),
        flag(value.rlike("^[0-9a-fA-F]+$")).alias("hex"),
        (F.size(F.array_distinct(F.split(value, ""))) / F.least(n, F.lit(40))).alias("distinct"),
        (count(turns) / n).alias("transitions"),
        F.array_max(F.transform(F.split(value, "[^A-Za-z]+"), F.length)).cast("double").alias("runs"),
        (1 - F.length(F.regexp_replace(F.lower(value), DICTIONARY, "")) / n).alias("coverage"),
        flag(before.rlike(r"(?:[/\\@.~]|https?:\S*)$") | value.rlike("/.*/") | after.rlike(r"^(?:[/\\@.]\w|[(\[{])")).alias("path"),
        flag(before.rlike(NAMES)).alias("named"),
        flag(before.rlike(HARMLESS)).alias("harmless"),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")).alias("quoted"),
        flag(before.rlike(r"[=:]>?\s*[\"'`]?$")).alias("assigned"),
        flag(value.rlike(ISSUED)).alias("issued"),
        _share(value, "^A-Za-z0-9_+/=-").alias("marks"),
        flag(value.rlike("^[A-Za-z]+$")).alias("letters"),
    )


def _candidates(docs: DataFrame, text: Column, *kept: Column) -> DataFrame:
    """``kept``, the gaps between candidates, and for each candidate its lead, value and features."""
    df = docs.select(*kept, F.coalesce(text, F.lit("")).alias("body"))
    df = df.withColumn("gaps", F.split("body", CANDIDATE, -1)).withColumn("found", F.regexp_extract_all("body", F.lit(CANDIDATE), F.lit(0)))

    def parts(match: Column) -> Column:
        lead = F.regexp_extract(match, LEAD, 0)
        return F.struct(lead.alias("lead"), F.substr(match, F.length(lead) + 1).alias("value"))

    def describe(c: Column, i: Column) -> Column:
        gap, following = F.get(F.col("gaps"), i), F.get(F.col("gaps"), i + 1)
        before = F.right(F.concat(F.right(gap, F.lit(48)), c["lead"]), F.lit(80))
        return F.struct(
            c["lead"].alias("lead"),
            c["value"].alias("value"),
            (F.length(gap) + F.length(c["lead"])).alias("gap"),
            _features(c["value"], before, F.left(following, F.lit(16))).alias("f"),
        )

    df = df.withColumn("found", F.transform("found", parts))
    return df.withColumn("found", F.transform("found", describe)).drop("body")


def labelled_findings(n: int = 2400, seed: int = 11) -> list[tuple[str, int]]:
    """Findings with their labels, by rule from a seed: lines that hold one candidate each."""
    rng = random.Random(seed)
    pick = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    syllables = ["the", "an", "er", "on", "re", "ti", "ing", "ou", "en", "st", "la", "de", "mi", "ver", "sch", "co"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    some = lambda: " ".join(word() for _ in range(rng.randint(1, 6)))
    digit = lambda s: s[: len(s) // 2] + rng.choice(dig) + s[len(s) // 2 + 1 :]
    key = lambda: rng.choice(["token", "api_key", "secret", "password", "access_key", "auth_token", "client_secret", "Authorization: Bearer", "private_key", "credential"])
    dictionary = DICTIONARY.split("|")

    def secret() -> str:
        kind = rng.randrange(5)
        if kind == 0:
            return digit(pick(dig + "abcdef", rng.choice([32, 40, 40, 40, 48, 64])))
        if kind == 1:
            return digit(pick(low + up + dig, rng.randint(20, 64)))
        if kind == 2:
            return digit(pick(low + up + dig + "+/", rng.randint(30, 70))) + rng.choice(["", "=", "=="])
        if kind == 3:
            return rng.choice(["ghp_" + pick(low + up + dig, 36), "AKIA" + digit(pick(up + dig, 16)), "sk_live_" + digit(pick(low + dig, 24)), "xoxb-" + pick(dig, 12) + "-" + pick(low + dig, 24)])
        return digit(pick(low + up + dig + "_-", rng.randint(24, 48)))

    def password() -> str:
        kind = rng.randrange(4)
        if kind == 0:
            return word().capitalize() + word() + pick(dig, rng.randint(2, 4)) + pick("!@#$%&*", rng.randint(0, 2))
        if kind == 1:
            return pick(low + up + dig + "!@#$%^&*.", rng.randint(8, 15))
        if kind == 2:
            return (word() + word() + pick(dig, rng.randint(0, 4)) + word() + pick(dig, 2))[-14:]
        return rng.choice(["", "-"]).join(word() + rng.choice(syllables) for _ in range(rng.randint(4, 6)))

    def named() -> tuple[str, str]:
        kind, lead = rng.randrange(6), rng.choice([f"{key()}: ", f"{key()} = ", f"{key()}=", f"{key()}: '"])
        if kind == 0:
            return lead, rng.choice(["required", "optional", "string", "undefined", "changeme", "redacted", "hidden", "your_password", "placeholder", "example"])
        if kind == 1:
            return lead.rstrip("'"), rng.choice(["get", "self", "config", "user", "request", "os", "new"]) + rng.choice([".", "_"]) + rng.choice(dictionary) + rng.choice(["", "_" + word(), "." + word(), "_" + rng.choice(dictionary)])
        if kind == 2:
            return f"{word()} {rng.choice(['secret', 'token', 'password'])}: ", (word() + rng.choice(syllables) + "ing")[:12]
        if kind == 3:
            return lead, rng.choice(["*", "x", "."]) * rng.randint(6, 12) + "x"
        if kind == 4:
            return lead.rstrip("'"), rng.choice(["Optional", "SecretStr", "String", "bytes.Buffer", "process.env.PASSWORD", "None|str", "varchar"])
        return lead, word() + "_" + rng.choice(["token", "secret", "password", "key", "field"])

    def harmless() -> tuple[str, str]:
        if rng.random() < 0.25:
            return named()
        kind = rng.randrange(10)
        if kind == 0:
            return rng.choice(["", "card ", "order ", "+", "tel "]), pick(dig, rng.randint(16, 22))
        if kind == 1:
            return f"{word()}@", "mail" + pick(dig, 2) + "-" + word() + "-" + word() + "-server"
        if kind == 2:
            return rng.choice(["commit ", "sha1 ", "md5: ", "checksum = ", "revision "]), digit(pick(dig + "abcdef", rng.choice([32, 40, 64])))
        if kind == 3:
            return rng.choice(["", "id ", "uuid: "]), "-".join(pick(dig + "abcdef", k) for k in (8, 4, 4, 4, 12))
        if kind == 4:
            return rng.choice(["/", "https://www.", "src/"]), "/".join([rng.choice(dictionary), word() + pick(dig, 2), word(), rng.choice(dictionary)]) + "/a"
        if kind == 5:
            return rng.choice(["", "= ", '"']), "_".join([word(), rng.choice(dictionary), word(), pick(dig, rng.randint(1, 3))]) + "_value"
        if kind == 6:
            return rng.choice([f"{key()} = \"", f"{key()}: "]), rng.choice(["your_" + "api_key_here_" + pick(dig, 1), "x" * 20 + "1", "example_" + "value_0000_" + "placeholder", "0" * 24, "1234567890abcdef1234"])
        if kind == 7:
            return "", pick(dig, 4) + "-" + pick(dig, 2) + "-" + pick(dig, 2) + "-" + word() + "-" + word() + "-" + word()
        if kind == 8:
            return "", word() + word() + word() + word() + word() + pick(dig, 1) + word()
        return rng.choice(["version ", "v", "build "]), pick(dig, 3) + "-" + rng.choice(dictionary) + "-" + pick(dig, 8) + "-" + word() + "-x"

    out = []
    for i in range(n):
        if i % 2:
            value = secret()
            lead = rng.choice([f'{key()} = "', f"{key()}={''}", f"{key()}: ", f'"{key()}": "', f"{key()} is ", f"{key()} "])
            if rng.random() < 0.06 and value[:4] in ("ghp_", "AKIA", "sk_l", "xoxb"):
                lead = ""
            elif rng.random() < 0.25:
                value = password()
                lead = rng.choice([f'{key()} = "', f"{key()}='", f"{key().upper()}=", f"{key()}: ", f"{word()}://{word()}:"])
                if lead.endswith(":"):
                    out.append((f"{some()} {lead}{value.replace('@', '!')}@{word()}.{word()}.com/x {some()}", 1))
                    continue
        else:
            lead, value = harmless()
        tail = lead[-1] if lead.endswith(('"', "'")) else rng.choice(["", ".", ",", "!!", "###"])
        out.append((f"{some()} {lead}{value}{tail} {some()}", i % 2))
    return out


def train(spark: SparkSession, findings: list[tuple[str, int]] | None = None, trees: int = 25, depth: int = 7) -> list[Tree]:
    """A forest on labelled findings: texts whose first candidate is a secret (1) or is not (0)."""
    rows = labelled_findings() if findings is None else findings
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(rows)], "i long, body string, y int")
    found = _candidates(df, F.col("body"), F.col("i"), F.col("y")).where(F.size("found") > 0).select("i", "y", F.get("found", F.lit(0)).alias("c"))
    table = np.array(found.orderBy("i").select("y", *(F.col(f"c.f.{n}").cast("double").alias(n) for n in FEATURES)).collect(), float)
    return random_forest(table[:, 1:], table[:, 0], trees=trees, depth=depth)


def _scored(docs: DataFrame, text: Column, forest: list[Tree], *kept: Column) -> DataFrame:
    """``kept``, ``gaps`` and of each candidate ``lead, value, gap, score``."""
    names = [f"c.f.{n}" for n in FEATURES]
    votes = " + ".join(f"({t.sql(names)})" for t in forest)
    scored = f"transform(found, c -> named_struct('lead', c.lead, 'value', c.value, 'gap', c.gap, 'score', ({votes}) / {len(forest)}D))"
    return _candidates(docs, text, *kept).withColumn("found", F.expr(scored))


#: Candidates that are placed at a time, so that a text of many takes no square of their number.
_RUN = 256
_PLACED = "array<struct<start:int,length:int,score:double,kind:string>>"


def _placed(threshold: float) -> Column:
    """Place, length, score and kind of the candidates over the threshold, by runs of candidates."""
    run = f"""aggregate(slice(found, b * {_RUN} + 1, {_RUN}), named_struct('at', 0, 'out', cast(array() AS {_PLACED})),
      (acc, c) -> named_struct('at', acc.at + c.gap + length(c.value), 'out',
        CASE WHEN c.score >= {threshold}D THEN concat(acc.out, array(named_struct(
          'start', acc.at + c.gap, 'length', length(c.value), 'score', c.score,
          'kind', CASE WHEN startswith(c.value, '-----BEGIN') THEN 'private-key' WHEN c.value RLIKE '^[0-9a-f]{{16,}}$' THEN 'hex'
                       WHEN length(c.value) < 16 OR NOT c.value RLIKE '[0-9]' THEN 'password' ELSE 'token' END)))
        ELSE acc.out END))"""
    runs = f"CASE WHEN size(found) > 0 THEN transform(sequence(0, (size(found) - 1) div {_RUN}), b -> {run}) ELSE array() END"
    return F.expr(
        f"""aggregate({runs}, named_struct('at', 0, 'out', cast(array() AS {_PLACED})),
              (acc, r) -> named_struct('at', acc.at + r.at, 'out', concat(acc.out, transform(r.out,
                s -> named_struct('start', s.start + acc.at, 'length', s.length, 'score', s.score, 'kind', s.kind)))),
              acc -> acc.out)"""
    )


def scan_secrets(
    docs: DataFrame, forest: list[Tree] | None = None, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col, n_candidates, n_secrets, score, secrets``, a row for each row of ``docs``.

    Candidates are private key blocks, runs of 16 token characters or more with a digit, and values
    of six characters or more behind a word that names a secret, or between user and host of a URL.
    ``secrets`` holds place (characters before), length, score and kind of each candidate that the
    forest gives ``threshold`` or more; ``score`` is the highest of all candidates, 0 without one.
    Null and empty texts have no candidates. Repeated rows are scanned apiece; an empty table gives
    an empty one; other columns are not read. DataFrame functions only, and no shuffle.
    """
    forest = train(docs.sparkSession) if forest is None else forest
    df = _scored(docs, column(text_col), forest, column(id_col).alias("id"))
    df = df.select("id", F.size("found").cast("long").alias("n"), F.array_max(F.transform("found", lambda c: c["score"])).alias("top"), _placed(threshold).alias("secrets"))
    return df.select(
        F.col("id").alias(id_col),
        F.col("n").alias("n_candidates"),
        F.size("secrets").cast("long").alias("n_secrets"),
        F.coalesce("top", F.lit(0.0)).alias("score"),
        "secrets",
    )


def redact_secrets(
    docs: DataFrame, forest: list[Tree] | None = None, threshold: float = 0.5, text_col: str = "text",
    mark: str = "[SECRET]", length_col: str | None = None,
) -> DataFrame:
    """``docs`` with each secret in the text replaced by ``mark``; other texts, and nulls, stay as they are.

    The word that names a secret stays. ``length_col`` names a column that holds the text's length
    and follows it. Other columns pass through, whatever their names.
    """
    forest = train(docs.sparkSession) if forest is None else forest
    whole = F.struct(*(column(c).alias(c) for c in docs.columns)).alias("row")
    df = _scored(docs, column(text_col), forest, whole)
    parts = F.transform(
        F.col("found"),
        lambda c, i: F.concat(F.get(F.col("gaps"), i), c["lead"], F.when(c["score"] >= threshold, F.lit(mark)).otherwise(c["value"])),
    )
    clean = F.concat(F.array_join(parts, ""), F.element_at("gaps", -1))
    hit = F.exists("found", lambda c: c["score"] >= threshold)
    df = df.select("row", F.when(hit, clean).alias("clean"))
    out = {c: F.col("row").getField(c) for c in docs.columns}
    out[text_col] = F.coalesce(F.col("clean"), out[text_col])
    if length_col is not None:
        kind = next(f.dataType for f in docs.schema if f.name == length_col)
        out[length_col] = F.coalesce(F.length("clean").cast(kind), out[length_col])
    return df.select(*(out[c].alias(c) for c in docs.columns))
