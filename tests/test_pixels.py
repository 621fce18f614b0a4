import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import pixels, similarity


def picture(seed, height=240, width=320):
    """A smooth random field with some texture, as BGR."""
    rng = np.random.default_rng(seed)
    coarse = rng.random((9, 9)) * 255
    y, x = np.linspace(0, 7.999, height), np.linspace(0, 7.999, width)
    fy, fx = (y % 1)[:, None], (x % 1)[None]
    at = lambda dy, dx: coarse[np.ix_(y.astype(int) + dy, x.astype(int) + dx)]
    gray = (at(0, 0) * (1 - fx) + at(0, 1) * fx) * (1 - fy) + (at(1, 0) * (1 - fx) + at(1, 1) * fx) * fy
    return np.repeat(np.clip(gray + rng.normal(0, 4, gray.shape), 0, 255).astype(np.uint8)[..., None], 3, 2)


def test_preview_is_a_box_mean():
    image = picture(1, 50, 40)
    assert np.array_equal(pixels.preview(image, 64), np.floor(image @ np.array([0.114, 0.587, 0.299]) + 0.5).astype(np.uint8))
    assert pixels.preview(image, 25).shape == (25, 20)


def test_a_crop_finds_its_original(spark):
    originals = {f"p{i}": picture(i) for i in range(5)}
    query = originals["p3"][:192, 32:288]
    rows = [("q", n, n, bytearray(query.tobytes()), query.shape[1], query.shape[0], bytearray(p.tobytes()), p.shape[1], p.shape[0]) for n, p in originals.items()]
    pairs = spark.createDataFrame(rows, "query string, candidate string, day string, query_data binary, query_width int, query_height int, data binary, width int, height int")
    scored = pixels.score_pairs(pairs).withColumn("compared", F.lit(5))
    found = similarity.decide_by_margin(scored, "query", "candidate", "fine", "day").first()
    assert (found.best, found.decisive) == ("p3", True)
    absent = similarity.decide_by_margin(scored.filter("candidate <> 'p3'"), "query", "candidate", "fine", "day").first()
    assert not absent.decisive


def test_hamming_and_signs(spark):
    df = spark.createDataFrame([([1.0, -1.0, 2.0], [1.0, 1.0, -2.0])], "a array<float>, b array<float>")
    assert df.select(similarity.hamming(similarity.sign_bits(F.col("a")), similarity.sign_bits(F.col("b"))).alias("d")).first().d == 2
