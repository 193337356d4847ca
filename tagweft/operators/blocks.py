"""Texts under their nearest heading: a table function over the nodes of a document in order."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")


@udtf(returnType="page_id long, node_id int, heading_id int, level int, heading string, text string")
class TextBlocks:
    """Takes rows (page_id, node_id, subtree_end, name, value) of one document in order of node_id, and gives a row for each
    text outside headings. It keeps the latest heading and nothing else, so a document's length doesn't matter."""

    def __init__(self):
        self.heading, self.end, self.words = None, -1, []

    def eval(self, row) -> Iterator[tuple]:
        if row["name"] in HEADINGS and row["node_id"] > self.end:
            self.heading, self.end, self.words = row, row["subtree_end"], []
        elif row["name"] is None and row["value"] is not None:
            if row["node_id"] <= self.end:
                self.words.append(row["value"])
            else:
                h = self.heading
                yield row["page_id"], row["node_id"], h and h["node_id"], h and int(h["name"][1]), h and "".join(self.words), row["value"]


def text_blocks(nodes: DataFrame) -> DataFrame:
    """page_id, node_id, heading_id, level, heading, text: each text with the heading before it, nulls if there is none."""
    spark = nodes.sparkSession
    texts = F.col("node_type") == "text"
    rows = nodes.where(texts | F.col("name").isin(*HEADINGS)).select("page_id", "node_id", "subtree_end", F.when(~texts, F.col("name")).alias("name"), F.when(texts, F.col("value")).alias("value"))
    spark.udtf.register("tagweft_text_blocks", TextBlocks)
    return spark.sql("SELECT * FROM tagweft_text_blocks(TABLE(SELECT * FROM {rows}) PARTITION BY page_id ORDER BY node_id)", rows=rows)
