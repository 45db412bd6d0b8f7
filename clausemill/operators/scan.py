"""Personal data and secrets, line by line, with allow-lists.

Texts without a hint of any detector are passed over before a line is split off; lines
are matched within their row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from clausemill.functions import text as T

# The detectors' patterns, and what they allow.
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9][A-Za-z0-9.-]*\.[A-Za-z]{2,}"
EMAIL_ALLOWED = r"(?i)^[^@]+@users\.noreply\.github\.com$|^git@|^[^@]+@(example|example\.com|example\.org|test|localhost)$"
PHONE = r"(?<![0-9])1[3-9][0-9]{9}(?![0-9])"
ID_CARD = r"(?<![0-9])[0-9]{17}[0-9Xx](?![0-9])"
PRIVATE_IP = r"(?<![0-9.])(192\.168\.[0-9]{1,3}\.[0-9]{1,3}|10\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}|172\.(?:1[6-9]|2[0-9]|3[01])\.[0-9]{1,3}\.[0-9]{1,3})(?![0-9.])"
SECRET_KEY = r"sk-[A-Za-z0-9]{8,}"
SECRET_ASSIGN = r"(?i)(?<![A-Za-z0-9])(api[_-]?key|secret|password|passwd|token|access[_-]?key)\s*[:=]\s*[\"']?([^\s\"'#,;]{8,})"
CODE = r"[(\[]|\.\w+\s*\(|^os\.|^self\.|^config\.|^str\.|^int\."
PERSONAL_PATH = r"(?<![\w.])[A-Za-z]:[\\/]+Users[\\/]+([^\s\\/'\"`(),;、。，（）]+)"
PLACEHOLDERS = ("xx", "xxx", "xxxx", "username", "user", "name", "yourname", "your-name", "...", "…", "某用户", "机主名", "用户名")

NOREPLY = r"(?i)@users\.noreply\.github\.com$"
#: Samples of the self-test: kind, whether it must be found, parts.
SAMPLES: tuple[tuple[str, bool, tuple[str, ...]], ...] = (
    ("email", True, ("write to ada", "@", "lovelace.test-mail.net")),
    ("phone", True, ("call 139", "0000", "1111 now")),
    ("id_card", True, ("card 320102", "19800101", "123x")),
    ("private_ip", True, ("host 172.", "20.3.4 up")),
    ("secret_sk", True, ("s", "k-", "ABCDEFGH99")),
    ("secret_assign", True, ("pass", "word = 'opensesame1'")),
    ("personal_path", True, ("see D:\\", "Users\\", "ada\\notes")),
    ("email", False, ("7+ada@users.", "noreply.github.com")),
    ("email", False, ("ada@", "example.com")),
    ("phone", False, ("number 5139", "00001111")),
    ("private_ip", False, ("version 172.", "40.3.4")),
    ("secret_assign", False, ("token = ", "config.get('token')")),
    ("personal_path", False, ("C:\\Users\\", "<username>\\x")),
)

HINT = r"(?i)@|[0-9]{11}|192\.168|10\.[0-9]|172\.[0-9]|sk-|key|secret|passw|token|users[\\/]"
KINDS = ("email", "phone", "id_card", "private_ip", "secret_sk", "secret_assign", "personal_path")


def _found(kind: str, excerpts: Column) -> Column:
    return F.transform(excerpts, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("excerpt")))


def detect(line: Column) -> Column:
    """Array of (kind, excerpt) in detector order."""
    every = lambda pattern, g=0: F.regexp_extract_all(line, F.lit(pattern), g)
    emails = F.filter(every(EMAIL), lambda x: ~x.rlike(EMAIL_ALLOWED))
    assigned = F.transform(
        F.filter(F.arrays_zip(every(SECRET_ASSIGN, 1).alias("k"), every(SECRET_ASSIGN, 2).alias("v")), lambda x: ~x["v"].rlike(CODE)), lambda x: x["k"]
    )
    placeholder = lambda u: u.rlike("^[<%{$`\\[]") | F.lower(u).isin(*PLACEHOLDERS)
    users = F.filter(every(PERSONAL_PATH, 1), lambda u: ~placeholder(u))
    return F.concat(
        _found("email", emails), _found("phone", every(PHONE)), _found("id_card", every(ID_CARD)), _found("private_ip", every(PRIVATE_IP, 1)),
        _found("secret_sk", every(SECRET_KEY)), _found("secret_assign", assigned), _found("personal_path", users),
    )


def hits(texts: DataFrame, label: str, text: str = "text") -> DataFrame:
    """``label``, lineno (from 1), n (order within the line), kind, excerpt."""
    lines = texts.where(F.col(text).rlike(HINT)).select(label, F.posexplode(T.split_lines(F.col(text))).alias("_i", "_line"))
    found = lines.where(F.col("_line").rlike(HINT)).select(label, (F.col("_i") + 1).alias("lineno"), F.posexplode(detect(F.col("_line"))).alias("n", "_h"))
    return found.select(label, "lineno", "n", "_h.kind", "_h.excerpt")


def commit_pairs(commits: DataFrame) -> DataFrame:
    """Distinct (author, committer) addresses of ``commits`` (author, committer)."""
    return commits.select("author", "committer").distinct()


def commit_hits(commits: DataFrame) -> DataFrame:
    """role and address of every distinct pair's addresses that aren't private ones of the forge."""
    roles = F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("address")) for r in ("author", "committer")]))
    return commit_pairs(commits).select(roles.alias("_r")).select("_r.*").where(~F.col("address").rlike(NOREPLY))


def self_test(spark: SparkSession) -> DataFrame:
    """Samples that the detectors get wrong: sample, kind, expected. Samples are put together here, so that no text holds a whole one."""
    rows = [(i, kind, "".join(parts), expected) for i, (kind, expected, parts) in enumerate(SAMPLES)]
    texts = spark.createDataFrame(rows, "sample int, kind string, text string, expected boolean")
    found = hits(texts, "sample").select("sample", "kind").distinct().withColumn("_hit", F.lit(True))
    out = texts.join(found, ["sample", "kind"], "left")
    return out.where(F.coalesce("_hit", F.lit(False)) != F.col("expected")).select("sample", "kind", "expected")


def gate(found: DataFrame) -> int:
    """Exit code of a scan: 0 if clean, else 1."""
    return int(found.limit(1).count() > 0)


def crlf(texts: DataFrame, label: str, text: str = "text") -> DataFrame:
    """Texts with Windows line ends."""
    return texts.where(F.contains(text, F.lit("\r\n"))).select(label)


def is_binary(content: Column) -> Column:
    """A zero byte among the first 8192."""
    return F.contains(F.substring(content, 1, 8192), F.lit(b"\0"))
