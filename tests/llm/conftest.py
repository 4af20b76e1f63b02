import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

DATA = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, n long, h string, id long, size int"


def edge_texts():
    """Texts that operators must take: null, empty, white space, ties, long, near and partial copies."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioumnrstl") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    base = prose(120)
    near = base.split()
    near[60] = "changed"
    chain = base.split()
    chain[60] = "changed"
    chain[10] = "other"
    passage = prose(60)
    return [
        None, "", " \t\n ", "one", "One", "two words", "a  b\tc", base, base, " ".join(near), " ".join(chain),
        base.upper(), passage, prose(50) + " " + passage + " " + prose(50), prose(80) + "\n" + passage,
        "x" * 1000, "ab" * 400, prose(20_000), "é è ü " + prose(30), "1234 5678 ,,, !!!", "<|endoftext|> a b",
        prose(8), prose(9), "naïve café " * 40, "tie tie tie", "tie tie tie",
        "a", "é", "-", "Größere größere Grössere straßen " * 20 + "größere", "x  \n\n \t y<|endoftext|><|endoftext|> \r\n",
        "中文字符 русский текст 😀 ٣٤ don't we'll", "Zß" * 3000,
    ]


@pytest.fixture(scope="session")
def folder(spark, tmp_path_factory):
    """A small folder of tables with edge rows, repeated rows and further columns of clashing names."""
    path = tmp_path_factory.mktemp("llm")
    docs = [(r.doc_id, r.text, r.lang, r.source, r.n_chars, 1, "h", 2, 3)
            for r in spark.read.parquet(f"{DATA}/documents.parquet").where("doc_id < 60").collect()]
    items = spark.read.parquet(f"{DATA}/benchmark.parquet").limit(12).collect()
    langs = ["en", None, "fr"]
    for k, text in enumerate(edge_texts()):
        docs.append((1000 + k, text, langs[k % 3], None if k % 4 == 0 else f"s{k % 3}", None, None, None, None, None))
    near = list(items[3].text)
    near[40:42], near[90:91] = "zz", ""
    docs += [(2000, "Before. " + items[2].text + " After.", "en", "s1", 0, 0, "", 0, 0),
             (2001, "Before. " + "".join(near).replace(" ", "  \n").upper() + " After.", "en", "s1", 0, 0, "", 0, 0),
             (2002, items[4].text[:50], "en", "s1", 0, 0, "", 0, 0)]
    docs.append(docs[5])
    spark.createDataFrame(docs, DOCUMENTS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(
        [(r.item_id, r.text, "x") for r in items] + [(900, None, "x"), (901, "", "x"), (902, "short", "x")],
        "item_id long, text string, doc_id string").write.parquet(f"{path}/benchmark.parquet")
    pages = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{DATA}/pages.parquet").limit(30).collect()]
    big = "<p>" + "same page " * 200
    pages += [(5000, None, big), (5001, "http://a b/\n", big), (5002, "http://c", big), (5003, "http://d", None),
              (5004, "http://e", ""), (5005, "http://f", "small"), (5006, "http://g", "small"),
              (5007, "http://h", "x\r\n\r\nWARC/1.1\r\nfiledesc://y 1 2 3 4\n" * 40),
              (5008, "filedesc://i.arc", "a page"), (5009, "filedesc:", big)]
    spark.createDataFrame(pages, "page_id long, url string, html string").withColumnRenamed(
        "html", "html").repartition(2).write.parquet(f"{path}/pages.parquet")
    rng = random.Random(9)
    vector = lambda: [rng.gauss(0, 1) for _ in range(16)]
    close = lambda v, s: [x + rng.gauss(0, s) for x in v]
    vectors = []
    for label in (0, 1, None):
        centre = vector()
        vectors += [(label, close(centre, s)) for s in [0.05] * 8 + [0.2] * 30] + [(label, centre)] * 3
        vectors += [(label, vector()) for _ in range(10)]
    vectors += [(0, None), (0, []), (0, [0.0] * 16), (0, [float("nan")] * 16), (0, [None] * 16), (1, [1.0, 2.0]), (1, [2.0, 4.0])]
    spark.createDataFrame(
        [(k, v, label, "b", 1) for k, (label, v) in enumerate(vectors)],
        "vec_id long, embedding array<double>, label int, block string, node int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="session")
def documents(spark, folder):
    return [(r.doc_id, r.text, r.source, r.lang) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
