import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


#: Rows every operator on documents must stand: nulls, empty and blank texts, ties, repeated rows, a long text.
EDGE = [
    (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \n\t ", None, None, 4), (4, "x", "en", None, 1),
    (5, "one two three four five six seven eight nine ten eleven twelve.", "en", "b", 64),
    (5, "one two three four five six seven eight nine ten eleven twelve.", "en", "b", 64),
    (6, "one two three four five six seven eight nine ten eleven twelve.", "en", "a", 64),
    (None, "a text without an id, of more than ten words in all, with an end.", "en", "a", 1),
    (8, "word " * 30_000 + "end.", "en", "b", 1), (9, "\x00 é 漢字 <|endoftext|> don't\x0bstop", "en", "c", 1),
]
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns named like the operators' own.
CLASH = {"size": 1, "copies": 2, "kept": True, "fingerprint": "f", "piece": 1, "_row": 1, "n_words": 1, "target": 1.5, "rank": 1, "_text": "t",
         "keep_id": 1, "_lines": 1, "clean_text": "c", "text_sha256": "s", "_source": "s", "bucket": 1, "least": 1, "_id": 1, "_sha": 1, "chance": 0.5}


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, COLUMNS)


@pytest.fixture(scope="session")
def clash(edge):
    from pyspark.sql import functions as F

    return edge.select("*", *[F.lit(v).alias(k) for k, v in CLASH.items()])


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def edge_rows():
    return EDGE
