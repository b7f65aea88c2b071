"""Unlearned languages in Latin script and letter noise go; texts of the learned languages stay."""

import random

from textloom.llm import langid

from .test_ops import docs

STRANGERS = {
    "fi": "tämä on suomenkielinen teksti jossa kerrotaan metsistä järvistä ja pitkistä talvista sekä ihmisten arjesta pohjoisessa maassa",
    "tr": "bu metin türkçe yazılmıştır ve ülkenin dağlarını göllerini ve uzun kışlarını anlatmaktadır insanlar köylerde yaşar",
    "pl": "ten tekst jest napisany po polsku i opowiada o lasach jeziorach oraz długich zimach w północnej części kraju",
    "cs": "tento text je napsán česky a vypráví o lesích jezerech a dlouhých zimách v severní části země",
    "sv": "denna text är skriven på svenska och berättar om skogar sjöar och långa vintrar i norra delen av landet",
}


def test_strangers_go_and_clean_texts_stay(spark):
    rng = random.Random(1)
    noise = " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 9))) for _ in range(200))
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    more = docs(spark, [(90000 + k, t) for k, t in enumerate([*STRANGERS.values(), noise])]).selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    out = langid.language_filter(rows.union(more))
    assert {r.doc_id for r in out.collect()} == {r.doc_id for r in rows.where(r"text RLIKE '\\p{L}'").collect()}
