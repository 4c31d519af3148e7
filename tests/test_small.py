import io

from pyspark.sql import functions as F

from docengine import log
from docengine.functions.bloom import Bloom


def test_bloom_filter(spark):
    df = spark.range(0, 5000, 5).withColumn("s", F.concat(F.lit("k"), F.col("id").cast("string")))
    numbers, names = Bloom.of(df, "id", 1000), Bloom.of(df, "s", 1000)
    assert all(numbers.might_contain(k) for k in range(0, 5000, 50)) and all(names.might_contain(f"k{k}") for k in range(0, 5000, 50))
    assert sum(numbers.might_contain(k) for k in range(5001, 7000)) < 100
    more = numbers.merged(Bloom.of(spark.range(9000, 9100), "id", 1000))
    assert more.might_contain(9050) and more.might_contain(0) and more.bits > 1000


def test_logger():
    out = io.StringIO()
    own = log.configure("WARNING", out)
    own.info("quiet")
    own.warning("loud %s", 1)
    log.configure("INFO", io.StringIO())
    own.warning("elsewhere")
    assert out.getvalue().count("\n") == 1 and "loud 1" in out.getvalue()
