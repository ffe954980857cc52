"""Classification of a stream of texts with a fitted model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ngrams import padded_char_ngrams, word_ngrams
from ..functions.text import classifier_tokens, normalised
from ..operators.classify import Classifier

MAX_MODEL_ROWS = 2_000_000  #: vocabulary and centroid entries that are sent to every task


def predict_stream(model: Classifier, stream: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, prediction`` of every row of a streaming (or plain) DataFrame, without state or shuffle.

    Grams are made by the same expressions as in batch; the model, whose size is
    bounded by vocabulary and labels and checked, goes to the tasks as arrays.
    Texts without known features get the first label.
    """
    o = model.options
    rows = model.vocabulary.select("feature", "feature_id", "idf").limit(MAX_MODEL_ROWS + 1).toPandas()
    entries = model.centroids.limit(MAX_MODEL_ROWS + 1).toPandas()
    if max(len(rows), len(entries)) > MAX_MODEL_ROWS:
        raise ValueError(f"the model has more than {MAX_MODEL_ROWS} entries; lower max_features")
    names = [r["label"] for r in model.classes.orderBy("label_id").collect()]
    place = {f: (i, w) for f, i, w in zip(rows["feature"], rows["feature_id"], rows["idf"])}
    matrix = np.zeros((len(names), len(rows) or 1))
    matrix[entries["label_id"], entries["feature_id"]] = entries["w"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for grams in b["grams"]:
                count: dict[str, int] = {}
                for g in grams:
                    if g in place:
                        count[g] = count.get(g, 0) + 1
                if not count:
                    out.append(names[0])
                    continue
                at = np.array([place[g][0] for g in count])
                w = np.array([(1 + np.log(c)) * place[g][1] for g, c in count.items()])
                score = np.round(matrix[:, at] @ (w / np.sqrt((w * w).sum())), 12)
                out.append(names[int(score.argmax())] if score.max() > 0 else names[0])
            yield pd.DataFrame({"id": b["id"], "prediction": out})

    clean = stream.select(F.col(id_col).cast("bigint").alias("id"), normalised(text_col).alias("t")).withColumn("w", classifier_tokens(F.col("t")))
    grams = F.concat(word_ngrams(F.col("w"), *o.word_range, "_", "w:"), padded_char_ngrams(F.col("t"), *o.char_range, o.gram_filter))
    return clean.select("id", grams.alias("grams")).mapInPandas(run, "id bigint, prediction string").withColumnRenamed("id", id_col)
