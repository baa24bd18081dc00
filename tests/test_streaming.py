"""Streams with late rows, over several runs from one checkpoint."""

import datetime as dt


from thermalis.streaming import city_day as cd

SCHEMA = "row_index long, ts timestamp, user_id long, city string, indicator int"
START = dt.datetime(2024, 1, 1)


def at(hours, user=1, row=0, city="a", indicator=1):
    return (row, START + dt.timedelta(hours=hours), user, city, indicator)


def arrive(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def spells(rows, gap, passed):
    """Finished spells by plain Python: (user, first, last, first row, posts)."""
    out = []
    for user in {r[2] for r in rows}:
        own = sorted((r[1], r[0]) for r in rows if r[2] == user)
        run = []
        for t, r in own:
            if run and t - run[-1][0] >= gap:
                out.append((user, run))
                run = []
            run.append((t, r))
        out.append((user, run))
    return sorted((u, r[0][0], r[-1][0], r[0][1], len(r)) for u, r in out if r[-1][0] + gap <= passed)


def test_spells_over_two_runs(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    first = [at(0, 1, 1), at(5, 1, 2), at(20, 1, 3), at(1, 2, 4), at(40, 2, 5)]
    arrive(spark, source, first)
    run = lambda: cd.run_to_end(cd.streaming_spells(cd.read_stream(spark, source, spark.read.parquet(source).schema), "user_id"), out, checkpoint)
    run()
    given = lambda: sorted((r.user_id, r.first_ts, r.last_ts, r.first_row, r.posts) for r in spark.read.parquet(out).collect())
    day, gap = dt.timedelta(days=1), dt.timedelta(hours=6)
    assert given() == spells(first, gap, START + dt.timedelta(hours=40) - day)
    # late, but within the watermark (16 h): joins the spell at 20 h with one of its own; then time passes
    late = [at(17, 1, 6), at(23, 1, 7), at(17, 3, 8)]
    arrive(spark, source, late)
    run()
    assert given() == spells(first, gap, START + dt.timedelta(hours=40) - day)
    last = [at(200, 9, 9)]
    arrive(spark, source, [*last, at(3, 1, 10)])  # row 10 lies before the watermark and is left out
    run()
    assert given() == spells(first + late + last, gap, START + dt.timedelta(hours=200) - day)
    before = given()
    run()  # nothing new
    assert given() == before


def test_city_days_and_late_rows(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    run = lambda: cd.run_to_end(cd.streaming_city_day(cd.read_stream(spark, source, spark.read.parquet(source).schema)), out, checkpoint)
    arrive(spark, source, [at(1, row=1), at(2, row=2, indicator=0), at(30, row=3)])
    run()
    assert spark.read.parquet(out).count() == 0  # the watermark stands at 6 h
    arrive(spark, source, [at(20, row=4), at(30, row=5, city="b")])
    run()
    arrive(spark, source, [at(80, row=6)])
    run()
    arrive(spark, source, [at(3, row=7)])  # too late
    run()
    got = sorted((r.city, r.date, r.heat_posts, r.observed_posts) for r in spark.read.parquet(out).collect())
    assert got == [("a", dt.date(2024, 1, 1), 2, 3), ("a", dt.date(2024, 1, 2), 1, 1), ("b", dt.date(2024, 1, 2), 1, 1)]


def test_first_seen(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    run = lambda: cd.run_to_end(cd.streaming_first_seen(cd.read_stream(spark, source, spark.read.parquet(source).schema), "user_id"), out, checkpoint)
    arrive(spark, source, [at(1, 1, 1), at(2, 2, 2), (3, START, None, "a", 1)])
    run()
    arrive(spark, source, [at(3, 1, 4), at(4, 3, 5)])
    run()
    assert sorted(r.row_index for r in spark.read.parquet(out).collect()) == [1, 2, 5]


def test_empty_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    arrive(spark, source, [])
    assert cd.drained(spark, cd.streaming_spells(cd.read_stream(spark, source, spark.createDataFrame([], SCHEMA).schema), "user_id"), "none").count() == 0
