import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from spanwright.session import build_session

    session = build_session("tests", "local[8]", **{
        "spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
        "spark.checkpoint.dir": str(tmp_path_factory.mktemp("checkpoint")),
        "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    return session


CONCEPT = ("doc_id long, cid int, text string, type string, start int, end int, "
           "assertions array<string>, candidates array<string>")


@pytest.fixture(scope="session")
def tables(spark):
    """(docs(dict), concepts(list of tuples)) builders."""

    def docs(texts):
        return spark.createDataFrame(list(texts.items()), "doc_id long, text string")

    def concepts(rows):
        return spark.createDataFrame([tuple(r) for r in rows], CONCEPT)

    return docs, concepts
