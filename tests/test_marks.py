"""Tables of patterns over texts in one pass: the columns of functions.source, made without their cost."""

import duckdb
from pyspark.sql import functions as F
from test_growth import moved

from siltstone.functions import source as C
from siltstone.operators.marks import marked
from siltstone.plans.source import CODE_TEXT, _code, source_effects

TEXTS = (
    None, "", "import redis\nx = os.getenv('A'); y = os.getenv( \"B\" ) + getenv('A')", "process.env.HOME process.env['X'] config.get('a.b') settings.DEBUG", "nothing to see", "open(f) open(f, 'wb') redis sqs ratE limit\nrequests.get",
    "mygetenv('no') Redis S3\x0bpublish(", "raise X\nexcept: logger.error(status_code = 404)", "cursor.execute select( celery stripe smtp sentry_sdk prisma pymongo",
)


def test_marks_equal_columns(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string").withColumn("low", F.lower("text"))
    t = F.col("text")
    got = marked(rows, {"systems": ("low", C.SYSTEMS), "hints": ("text", C.HINTS), "concepts": ("low", C.CONCEPTS)}, ("text", "low"), {"env": ("text", C.ENV_READS)})
    none = F.array().cast("array<string>")
    want = rows.select("id", C.systems(t).alias("systems"), C.failure_hints(t).alias("hints"), C.concepts(t).alias("concepts"), F.coalesce(C.env_names(t), none).alias("env"))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_boundaries_are_those_of_the_sql(spark):
    """A letter outside of ASCII ends a word there, which Java's patterns don't see."""
    rows = spark.createDataFrame([("\xe9redis", )], "text string")
    assert marked(rows, {"systems": ("text", C.SYSTEMS)}).first().systems == duckdb.sql("select ['Redis'] where regexp_matches('\xe9redis', '\\bredis\\b')").limit(1).fetchall()[0][0]


def test_derived_texts_equal_the_plain_patterns(spark):
    texts = [(x,) for x in (None, "", "_Ab cd. xEF gh,ij kl.9ab cd.", "la vie the cat  der der der ", "A b.c d,\xe9e f. the \xe9a the ab and cd ")]
    rows = spark.createDataFrame(texts, "text string").select(F.expr(CODE_TEXT).alias("a"), F.expr(_code("$", "")).alias("b"))
    assert all(r.a == r.b for r in rows.collect())


def test_effects_are_found_in_one_pass(spark):
    """Texts are neither shuffled nor made twice."""
    rows, shuffled = moved(spark, source_effects(spark, "/root/testdata/sf0.001"))
    assert len(rows) == 200 and shuffled == 0
