import time

from pyspark.sql import functions as F

from locuspark.queries import fixtures

def letter_by_letter(spark, line):
    """Reads by the plain formula of every letter."""
    spelled, fixtures._spelled = fixtures._spelled, lambda seq, qual: (seq, qual)
    try:
        return spark.sql(fixtures.reads_sql("spark").replace("FROM lineitem", "FROM {lineitem}"), lineitem=line)
    finally:
        fixtures._spelled = spelled


def by_strings(spark, line):
    return spark.sql(fixtures.reads_sql("spark").replace("FROM lineitem", "FROM {lineitem}"), lineitem=line)


def test_reads_are_those_of_the_formula(spark):
    n = spark.range(20000)
    keys = lambda least: [(F.pmod(F.xxhash64("id", F.lit(k)), F.lit(5000)) + least).alias(c) for k, c in enumerate(("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"))]
    odd = n.limit(4000).select(*keys(-2500)).unionByName(n.limit(40).select(*[F.when(F.col("id") % 4 != k, F.col("id")).alias(c) for k, c in enumerate(("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey"))]))
    rows = n.select(*keys(0)).unionByName(odd)
    a, b = by_strings(spark, rows), letter_by_letter(spark, rows)
    assert a.schema.simpleString() == b.schema.simpleString()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_a_read_takes_less_than_its_letters(spark):
    line = spark.range(0, 60000, 1, 4).select((F.col("id") % 1000).alias("l_suppkey"), F.col("id").alias("l_orderkey"), (F.col("id") % 7).alias("l_linenumber"), (F.col("id") % 20000).alias("l_partkey"))
    took = {}
    for run in (by_strings, letter_by_letter, by_strings):
        began = time.time()
        run(spark, line).agg(F.max("seq"), F.max("qual")).collect()
        took[run] = time.time() - began
    assert 2 * took[by_strings] < took[letter_by_letter]


def test_alleles_are_counted_once(spark):
    folder = "/root/testdata/sf0.001"
    a, b = fixtures.Fixture(spark, folder).alleles, fixtures.Fixture(spark, folder).alleles
    assert sorted(a.inputFiles()) == sorted(b.inputFiles())
    again = fixtures.Fixture(spark, folder)._sql(fixtures.ALLELES, v_reads=fixtures.Fixture(spark, folder).reads)
    assert a.schema.simpleString() == again.schema.simpleString()
    assert a.count() == again.count() and a.exceptAll(again).isEmpty()
