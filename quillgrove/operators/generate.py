"""Documents made from the register: the smallest of each element, and hostile ones by seed."""

from __future__ import annotations

import json
import random

from pyspark.sql import DataFrame, SparkSession

from ..plans.register import Register

VALUES = {"int": 1, "bool": True, "urn": "urn:made:1", "lang": "en", "hash": "0" * 64, "iri": "https://a.example/", "path": "a", "idref": "made", "text": "x"}
#: What rules ask for beside fields, by element.
INSIDE = {"list": "item", "contents": "item", "bibliography": "item", "term-list": "term", "signature-block": "term", "provenance": "term"}
#: Texts whose value has a shape of its own.
SHAPED = {("date", "value"): "2024", ("payload", "data"): "1"}


def smallest(element: str, reg: Register) -> dict:
    """The element with its required fields and nothing else that no rule asks for."""
    made: dict = {"t": element}
    for f in reg.elements[element].fields:
        if f.required:
            made[f.name] = SHAPED.get((element, f.name)) or (f.enum[0] if f.enum else VALUES[f.type])
    if element in INSIDE:
        made["c"] = [smallest(INSIDE[element], reg)]
    return made


def hosted(element: str, reg: Register) -> dict:
    """A document that holds the element where it may stand, and what it refers to."""
    note = {"t": "note", "id": "made", "c": [{"t": "paragraph", "c": [{"t": "text", "v": "x"}]}]}
    own = smallest(element, reg)
    if element == "document":
        return {**own, "c": [note]}
    if own.get("id") == VALUES["text"] or element == "note":
        own["id"] = "other"
    inside = {"t": "paragraph", "c": [own]} if reg.elements[element].cls == "inline" else own
    return {**smallest("document", reg), "c": [note, inside]}


def smallest_documents(spark: SparkSession, reg: Register) -> DataFrame:
    """doc_id (the element), raw: one document for each element of the register."""
    return spark.createDataFrame([(e, json.dumps(hosted(e, reg))) for e in reg.elements], "doc_id string, raw string")


def hostile(rnd: random.Random, depth: int = 0) -> dict:
    """A tree that breaks as many assumptions as it can: kinds of values, names, nesting."""
    value = [None, True, -(2**70), 2**70, "x\0", "", " ", "javascript:x", "//a", [], {}, [1, "x"], 5]
    out: dict = {rnd.choice(["t", "id", "v", "href", "level", "src", "odd"]): rnd.choice(value) for _ in range(rnd.randrange(5))}
    if rnd.random() < 0.8:
        out["t"] = rnd.choice(["document", "section", "text", "list", "item", "link", "heading", "media", "odd", 7])
    if rnd.random() < 0.7 and depth < 6:
        out["c"] = [hostile(rnd, depth + 1) if rnd.random() < 0.9 else rnd.choice(value) for _ in range(rnd.randrange(4))]
    return out


def hostile_documents(spark: SparkSession, n: int, seed: int = 0, partitions: int = 8) -> DataFrame:
    """doc_id, raw of n hostile documents; each is made from the seed and its number, wherever it is made."""

    def make(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["id"].astype(str), "raw": [json.dumps(hostile(random.Random(f"{seed}:{i}"))) for i in pdf["id"]]})

    return spark.range(0, n, 1, partitions).mapInPandas(make, "doc_id string, raw string")
