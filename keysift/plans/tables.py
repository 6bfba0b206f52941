"""The given tables as files to scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keysift.session import spread
from keysift.sources.files import from_table


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> Column:
    """lang/dir/id.txt; the language picks the directory, so context paths occur."""
    folder = (
        F.when(F.col("lang") == "de", "tests").when(F.col("lang") == "es", "docs").otherwise("src")
    )
    return F.concat_ws("/", "lang", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"),
                  "doc_id")
    return from_table(docs, F.col("source"), document_path(), F.col("text"))


def document_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """repo and path of the documents; the text is not read."""
    return table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), document_path().alias("path"))


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host; quotes are unescaped so that assignments look as in source text."""
    pages = spread(table(spark, sf_dir, "pages").select("page_id", "url", "html"), "page_id")
    return from_table(
        pages,
        F.regexp_extract("url", "^https?://([^/?#]+)", 1),
        F.concat(F.col("page_id").cast("string"), F.lit(".html")),
        F.replace("html", F.lit("&quot;"), F.lit('"')),
    )


def conversation_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spread(
        table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"),
        "conv_id", "turn")
    return from_table(
        turns, F.col("role"),
        F.concat_ws("/", F.col("conv_id").cast("string"),
                    F.concat(F.col("turn").cast("string"), F.lit(".txt"))),
        F.col("text"),
    )


def all_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        document_files(spark, sf_dir)
        .unionByName(page_files(spark, sf_dir))
        .unionByName(conversation_files(spark, sf_dir))
    )


def _planted_lines() -> list[Column]:
    """Made-up credentials from the hash of each text, assembled here and never stored."""
    h = F.sha2("content", 256)
    up = F.upper(h)

    def value(*parts: object) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    return [
        value("id = ", "AK", "IA", F.substring(up, 1, 16)),
        value("aws_", "secret_key = ", F.substring(h, 1, 40)),
        value("first ", "gh", "p_", F.substring(h, 1, 36), " then ", "gh", "s_",
              F.substring(h, 5, 36)),
        value("xo", "xb-", F.substring(h, 1, 24)),
        value("sk", "_live_", F.substring(h, 10, 24)),
        value("use sk", "-", F.substring(h, 3, 40), ";"),
        value("\"auth\": \"", F.substring(h, 1, 32), "\""),
        value("postgres", "://app:", F.substring(h, 7, 20), "@db.internal/main"),
        value("dd_", "api_key: ", F.substring(h, 1, 32)),
        value("npm", "_", F.substring(h, 20, 36)),
        value("password = \"your_", F.substring(h, 1, 20), "\""),
        value("{\"type\": \"", "service", "_account\"}"),
    ]


def planted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with one line per planted credential after their text."""
    files = document_files(spark, sf_dir)
    return files.withColumn("content", F.concat_ws("\n", "content", *_planted_lines()))


def _catalogue_lines() -> list[Column]:
    """A made-up credential of every built-in pattern, from the hash ``h`` of each text.

    One line each, but for the key block at the end.
    """
    h, up = F.col("h"), F.upper("h")

    def line(*parts: object) -> Column:
        return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])

    def cut(size: int, at: int = 1) -> Column:
        return F.substring(h, at, size)

    digits = F.translate(h, "abcdef", "012345")
    return [
        line("id ", "AK", "IA", F.substring(up, 1, 16), ";"),
        line("aws_sec", "ret_access_key = \"", cut(40), "\""),
        line("{\"type\": \"service", "_account\"}"),
        line("\"private_", "key_id\": \"", cut(40, 3), "\""),
        line("k=AI", "za", cut(35)),
        line("Account", "Key=", h, cut(22), "==;"),
        line("azure_client_sec", "ret: q~", cut(34)),
        line("gh", "p_", cut(36)),
        line("gh", "s_", cut(36, 2)),
        line("github", "_pat_", cut(40)),
        line("gl", "pat-", cut(20)),
        line("xo", "xb-", cut(30)),
        line("https://hooks.sla", "ck.com/services/T", F.substring(up, 1, 8), "/B",
             F.substring(up, 9, 8), "/", cut(24)),
        line("M", cut(23), ".", cut(6, 30), ".", cut(27, 36)),
        line("https://dis", "cord.com/api/webhooks/", F.substring(digits, 1, 18), "/", h),
        line("sk", "_live_", cut(24)),
        line("rk", "_live_", cut(24, 9)),
        line("access_", "token$production$", cut(16), "$", cut(32, 17)),
        line("key sk", "-", cut(48), " "),
        line("sk", "-ant-", cut(40)),
        line("Bearer ey", "J", cut(12), ".", cut(20, 13), ".", cut(20, 33)),
        line("ssh-", "rsa ", h, cut(6), "== me@host"),
        line("post", "gres://user:", cut(15), "@db.host/name"),
        line("\"au", "th\": \"", cut(24), "==\""),
        line("dckr", "_pat_", cut(27)),
        line("np", "m_", cut(36)),
        line("py", "pi-", cut(60)),
        line("DD_", "APP_KEY=", cut(32)),
        line("NR", "AK-", F.substring(up, 1, 27)),
        line("https://", cut(32), "@o1.ingest.sen", "try.io/42"),
        line("S", "G.", cut(22), ".", cut(43, 20)),
        line("sid S", "K", cut(32), " "),
        line("mail key", "-", cut(32), " "),
        line("PassWord : '", cut(20), "'"),
        line("-----BEGIN", " PRIVATE", " KEY-----\n", h, "\n-----END", " PRIVATE", " KEY-----"),
    ]


def catalogue_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, a file with one credential of every built-in pattern."""
    files = document_files(spark, sf_dir).withColumn("h", F.sha2("content", 256))
    return files.withColumn("content", F.concat_ws("\n", *_catalogue_lines())).drop("h")


def long_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document, a file with secrets of 70 to 140 characters."""
    files = document_files(spark, sf_dir).withColumn("h", F.sha2("content", 256))
    h, tail = F.col("h"), F.substring("h", 1, 10)
    return files.withColumn("content", F.concat_ws(
        "\n",
        F.concat(F.lit("pass"), F.lit("word = \""), h, tail, F.lit("\"")),
        F.concat(F.lit("gh"), F.lit("p_"), h, tail, tail, tail),
        F.concat(F.lit("post"), F.lit("gres://app:"), h, h, tail, F.lit("@db.internal/main")),
        F.concat(F.lit("sk"), F.lit("-proj-"), h, F.lit("_"), tail, F.lit("-x")),
    )).drop("h")


def pem_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents between two key blocks whose bodies come from their hashes."""
    files = document_files(spark, sf_dir)

    def block(body: Column) -> Column:
        begin, end = ("-----" + word + " PRIVATE" + " KEY-----" for word in ("BEGIN", "END"))
        return F.concat_ws("\n", F.lit(begin), body, F.lit(end))

    return files.withColumn("content", F.concat_ws(
        "\n", block(F.sha2("content", 256)), "content", block(F.sha2("path", 256))))
