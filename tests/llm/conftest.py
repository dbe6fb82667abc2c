import sys
from pathlib import Path

import pytest

sys.path.append(str(Path(__file__).resolve().parent))


@pytest.fixture(scope="session")
def llm(spark):
    """The session with the package shipped to its Python workers."""
    from loanscope.llm.tables import ship

    ship(spark)
    return spark


@pytest.fixture(scope="session")
def docs(llm):
    """Documents of the smallest scale, with awkward rows added and extra
    columns whose names the operators use inside."""
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in
            llm.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang").collect()]
    text = {d: t for d, t, _ in rows}
    top = max(text) + 1
    extra = [
        None, "", " \n\t ", "one two", "ONE  two", "word", "a" * 700 + "b" + "a" * 300, "ab " * 800, "a" * 1500,
        "é" * 300, "é" * 301, text[3] + " " + text[5] + " " + text[3], text[3][50:400], text[3].replace(" ", "  "),
        "x y▁z ▁ <s> <|endoftext|> \U0001F917\n\n", " ".join(text.values())[:60000],
        text[5].replace("the", "that", 1), text[5].replace("the", "that", 2), "123 456 !!", "# $ %",
    ]
    rows += [(top + i, t, None if i % 2 else "en") for i, t in enumerate(extra)]
    data = [(d, t, lang, "s", 0, "h", 1) for d, t, lang in rows]
    df = llm.createDataFrame(
        data, "doc_id bigint, text string, lang string, source string, bucket int, hash string, cell bigint")
    return df.repartition(5).cache()


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
