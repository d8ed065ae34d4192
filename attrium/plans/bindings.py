"""Catalog, dictionary and review tables over the test data, as SQL that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Korean senses of the words of part names.
WORDS = "('ANVIL','모루'),('BLUE','파랑'),('BOLT','볼트'),('COLD','냉간'),('GEAR','기어'),('GIZMO','장치'),('HOT','고온'),('LARGE','대형'),('NEW','신규'),('OLD','구형'),('PLATE','판'),('RED','빨강'),('RING','고리'),('ROD','막대'),('SMALL','소형'),('WIDGET','부품')"
SECOND = "('RED','REDUCED','감소',3),('RING','RINGING','울림',2)"

VIEWS = {
    "cat_part": """SELECT CAST(p_partkey AS BIGINT) AS row_no, concat('row-', CAST(p_partkey AS STRING)) AS source_id, upper(replace(p_name, ' ', '_')) AS column_name,
        p_type AS table_name, p_brand AS table_description, CAST(p_size % 4 AS STRING) AS data_type, p_name AS column_description FROM {part}""",
    "cat_glued": "SELECT row_no, source_id, replace(column_name, '_', '') AS column_name, table_name, table_description, data_type, column_description FROM cat_part",
    "part_words": "SELECT row_no, source_id, split_part(column_name, '_', 1) AS word FROM cat_part UNION ALL SELECT row_no, source_id, split_part(column_name, '_', 2) AS word FROM cat_part",
    "korean": f"SELECT * FROM (VALUES {WORDS}) AS t(word, korean)",
    "dict_part": f"""SELECT w.word AS abbreviation, w.word AS full_name, k.korean AS korean_word, CAST(count(*) AS INT) AS occurrence_count FROM part_words w JOIN korean k ON k.word = w.word GROUP BY w.word, k.korean
        UNION ALL SELECT a, f, k, n FROM (VALUES {SECOND}) AS s(a, f, k, n)""",
    "dict_rows": "SELECT abbreviation, full_name, korean_word, occurrence_count, CAST(row_number() OVER (ORDER BY abbreviation, full_name DESC) AS BIGINT) AS row_no FROM dict_part",
    "cand_part": """SELECT CASE WHEN w.row_no % 13 = 0 THEN concat('x-', w.source_id) ELSE w.source_id END AS source_id, w.word AS abbreviation,
        CASE WHEN w.row_no % 7 = 0 THEN concat(w.word, 'S') ELSE w.word END AS full_name, k.korean AS korean_word FROM part_words w JOIN korean k ON k.word = w.word WHERE w.row_no % 11 <> 0""",
    "cat_said": """SELECT c.row_no, c.source_id, c.column_name, c.table_name, c.table_description, c.data_type, CASE WHEN c.row_no % 23 = 0 THEN '' ELSE concat(a.korean, ' ', b.korean) END AS column_description
        FROM cat_part c JOIN korean a ON a.word = split_part(c.column_name, '_', 1) JOIN korean b ON b.word = split_part(c.column_name, '_', 2)""",
    "cand_said": """SELECT source_id, CASE WHEN length(source_id) % 2 = 0 AND abbreviation = 'RED' THEN 'QQQ' ELSE abbreviation END AS abbreviation, full_name,
        CASE WHEN abbreviation = 'GEAR' AND length(source_id) % 2 = 1 THEN '없음' ELSE korean_word END AS korean_word FROM cand_part""",
    "dict_short": "SELECT * FROM dict_part WHERE abbreviation <> 'RED'",
    "cat_doc": """SELECT CAST(doc_id AS BIGINT) AS row_no, concat('row-', CAST(doc_id AS STRING)) AS source_id, 'TEXT' AS column_name, source AS table_name, lang AS schema_name,
        concat(text, CASE WHEN doc_id % 5 = 0 THEN concat(' ', source) ELSE '' END, CASE WHEN doc_id % 10 = 0 THEN concat('/', lang) ELSE '' END) AS column_description FROM {documents}""",
    "ratings": """SELECT concat('row-', CAST(d.doc_id AS STRING)) AS source_id, d.source AS review, d.lang AS stratum, CAST(1 + 4 * l.quality AS INT) AS clarity, CAST(5 - 2 * l.toxic AS INT) AS tone,
        CASE WHEN l.toxic = 1 THEN 'major' ELSE 'none' END AS severity, CASE WHEN d.doc_id % 2 = 0 THEN 'seen' ELSE '' END AS comment FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id""",
    "job_log": "SELECT CAST(user_id AS BIGINT) AS job, event_type AS stage, ts FROM {events}",
}
NEEDS = {
    "cat_part": (), "cat_glued": ("cat_part",), "part_words": ("cat_part",), "korean": (), "dict_part": ("part_words", "korean"), "dict_rows": ("dict_part",),
    "cat_said": ("cat_part", "korean"), "cand_said": ("cand_part",), "dict_short": ("dict_part",),
    "cand_part": ("part_words", "korean"), "cat_doc": (), "ratings": (), "job_log": (),
}
TABLES = ("part", "documents", "labels", "events")


def ctes(*names: str) -> str:
    """WITH clause that defines names and what they need, for DuckDB."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS[name]:
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    body = ", ".join(f"{n} AS ({VIEWS[n]})" for n in order)
    for t in TABLES:
        body = body.replace("{%s}" % t, t)
    return f"WITH {body}"


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    args = {n: view(spark, sf_dir, n) for n in NEEDS[name]}
    sql = VIEWS[name].replace("concat(", "concat_ws('', ")  # skips nulls, as DuckDB's concat does
    for n in args:
        sql = sql.replace(f"FROM {n} ", "FROM {%s} " % n).replace(f"JOIN {n} ", "JOIN {%s} " % n)
        if sql.endswith(f"FROM {n}"):
            sql = sql[: -len(n)] + "{%s}" % n
    args |= {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if "{%s}" % t in sql}
    return spark.sql(sql, **args)
