"""Ties that are exact on paper, where sums and differences of doubles leave last bits."""

from pyspark.sql import functions as F

from trackspark.operators import appearance, evidence, insights


def test_longest_segment_does_not_hang_on_last_bits(spark):
    short = 1.1 - 2e-16
    assert short < 1.1
    objects = spark.createDataFrame([(2, "2-0", 0.5), (2, "2-1", 1.1), (3, "3-2", short), (3, "3-4", 1.1)], "track_id long, segment_id string, duration_s double")
    assert sorted(r.segment_id for r in evidence.longest_segments(objects).collect()) == ["2-1", "3-2"]
    moved = objects.selectExpr("track_id", "segment_id", "0.0D AS timestamp_s", "1.0D AS speed_px_s")
    assert [r.segment_id for r in evidence.top_segment_profiles(objects.filter("track_id = 3"), moved, 1).collect()] == ["3-2"]


def test_a_track_of_just_two_seconds_is_stable(spark):
    short = 2.0 - 3e-16
    assert short < 2.0
    objects = spark.createDataFrame([(1, "1-0", short, 0.9, 0.9, 20.0), (2, "2-0", 1.9, 0.9, 0.9, 20.0)], "track_id long, segment_id string, duration_s double, raw_class_consistency double, color_confidence double, displacement_px double")
    assert [r.track_id for r in evidence.stable_tracks(objects).collect()] == [1]


#: Track 1: green and blue both have 1, green is first.  Track 2: red has 0.9 of 3.2, which is 0.28125.
VOTES = [(1, f, "green", 0.1) for f in range(10)] + [(1, 20, "blue", 1.0)] + [(2, f, "red", 0.1) for f in range(9)] + [(2, 20, "blue", 0.8), (2, 21, "white", 0.8), (2, 22, "black", 0.7)]


def colors(spark, parts=1):
    votes = spark.createDataFrame(VOTES, "track_id long, frame long, color string, confidence double").repartition(parts, "frame").coalesce(parts)
    return appearance.color_vote(votes, votes)


def test_color_vote_does_not_hang_on_the_order_of_adding(spark):
    for parts in (1, 3):
        got = {r.track_id: (r.dominant_color, r.color_confidence, r.color_samples) for r in colors(spark, parts).collect()}
        assert got == {1: ("green", 0.5, 11), 2: ("red", 0.2813, 12)}


#: Both colours have 2 + 513/1024, whose tenth and last place is a 5; green is first, from six thirds.
SHARES = [(1, f, "green", 1 / 3) for f in range(6)] + [(1, 10, "green", 513 / 1024), (1, 20, "blue", 1.0), (1, 21, "blue", 1.0), (1, 22, "blue", 513 / 1024)]


def test_color_vote_of_sums_between_two_places_and_of_long_sums(spark):
    shares = spark.createDataFrame(SHARES, "track_id long, frame long, color string, confidence double")
    # track 2: 330,000 thirds, whose double sum is not 110,000
    ids = spark.range(0, 330_000, 1, 3)
    long = ids.selectExpr("2L AS track_id", "id AS frame", "'red' AS color", "1 / 3.0D AS confidence").unionAll(ids.filter("id < 110000").selectExpr("2L", "id + 1000000", "'blue'", "1.0D"))
    votes = shares.unionAll(long)
    got = {r.track_id: (r.dominant_color, r.color_confidence, r.color_samples) for r in appearance.color_vote(votes, votes).collect()}
    assert got == {1: ("green", 0.5, 10), 2: ("red", 0.5, 440_000)}


def test_box_colours_of_a_tie(spark):
    b, g, r = (evidence.box_color(F.col("dominant_color"))[k] for k in range(3))
    got = {row.track_id: (row.b, row.g, row.r) for row in colors(spark).select("track_id", b.alias("b"), g.alias("g"), r.alias("r")).collect()}
    assert got == {1: (70, 200, 70), 2: (40, 40, 230)}


def objects(spark):
    raw = spark.createDataFrame([(t, f, 2, "car", 0.0, 0.0, 10.0, 5.0) for t in (1, 2) for f in range(3)], "track_id long, frame long, class_id int, class_name string, x1 double, y1 double, x2 double, y2 double")
    moved = raw.selectExpr("track_id", "concat(track_id, '-0') AS segment_id", "frame / 10.0D AS timestamp_s", "true AS observed", "1.0D AS speed_px_s", "1.0D * frame AS position_x_px", "0.0D AS position_y_px")
    sizes = spark.createDataFrame([(1, "car", 50.0, "medium_passenger_vehicle", "m"), (2, "car", 50.0, "medium_passenger_vehicle", "m")], "track_id long, class_name string, median_box_area_px2 double, relative_size_class string, size_method string")
    return insights.object_insights(raw, moved, colors(spark), sizes, 10.0)


def test_distributions_of_a_tie(spark):
    got = {(r.kind, r.label): r.tracks for r in insights.distributions(objects(spark)).filter("kind = 'color'").collect()}
    assert got == {("color", "green"): 1, ("color", "red"): 1}


def test_object_insights_of_a_tie(spark):
    assert {r.track_id: (r.dominant_color, r.color_confidence) for r in objects(spark).collect()} == {1: ("green", 0.5), 2: ("red", 0.2813)}
