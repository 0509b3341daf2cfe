"""A question from search to grounded answer: excerpts, prompt, claims, numbered citations, events. Models stay behind two small protocols."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from groundline.operators import grounding, retrieval
from groundline.streaming.claims import ClaimParser

QUESTION, TOP, HISTORY, REWRITE = 2000, 8, 6, 500


class Embedder(Protocol):
    def embed(self, texts: list[str], kind: str) -> list[list[float]]: ...


class Generator(Protocol):
    def rewrite(self, history: list[tuple[str, str]], question: str) -> str: ...

    def stream(self, prompt: str) -> Iterator[str]: ...


class Quoting:
    """The deterministic generator: the best excerpt's first line that is not blank, as one claim that quotes it."""

    def rewrite(self, history: list[tuple[str, str]], question: str) -> str:
        return question

    def stream(self, prompt: str) -> Iterator[str]:
        excerpts = json.loads(prompt)["excerpts"]
        line = next((x.strip() for x in excerpts[0]["extrait"].split("\n") if x.strip()), "") if excerpts else ""
        yield json.dumps({"claims": [{"text": line, "sources": [{"id": excerpts[0]["id"], "quote": line}]}] if line else []}, ensure_ascii=False)


def search_question(generator: Generator, history: list[tuple[str, str]], question: str) -> str:
    """The question as it is searched: rewritten if there is a history and the rewrite is usable, else as asked."""
    if not history:
        return question
    try:
        text = generator.rewrite(history[-HISTORY:], question).strip("\"«»` \n")
    except Exception:  # noqa: BLE001 - a provider may fail in any way, and the question still stands
        return question
    return text if 1 <= len(text) <= REWRITE else question


def excerpts(spark, chunks: DataFrame, vector: list[float], cutoff: float = retrieval.MODEL_CUTOFF, **scope: str | None) -> DataFrame:
    """(label, chunk_id, …, score) of the chunks of the scope that reach the cutoff, at most eight."""
    query = F.array(*[F.lit(float(x)) for x in vector])
    scored = retrieval.in_scope(chunks, **scope).withColumn("score", retrieval.cosine(F.col("embedding"), query))
    return retrieval.labelled(retrieval.top_chunks(scored, TOP), cutoff)


def prompt(question: str, rows: list, history: list[tuple[str, str]] = ()) -> str:
    """The prompt as JSON, so that an excerpt stays data whatever it says."""
    shown = [{"id": f"S{r['label']}", "cours": r["course_id"], "document": r["title"] or r["source_filename"], "section": r["section_title"], "page": r["physical_page_number"], "extrait": r["text"]} for r in rows]
    turns = [f"{'Étudiant' if role == 'user' else 'Assistant'} : {text}" for role, text in history[-HISTORY:]]
    return json.dumps({"history": turns, "question": question, "excerpts": shown}, ensure_ascii=False)


def answer(spark, chunks: DataFrame, embedder: Embedder, generator: Generator, question: str, history: list[tuple[str, str]] = (), cutoff: float = retrieval.MODEL_CUTOFF, **scope: str | None) -> Iterator[dict]:
    """The events of an answer in order: conversation and status, claims as they close, citations and completed; or one abstention or error."""
    question = question.strip()
    if not 1 <= len(question) <= QUESTION:
        yield {"type": "error", "message": "the question must have 1 to 2000 characters"}
        return
    yield {"type": "conversation"}
    yield {"type": "status", "stage": "searching"}
    searched = search_question(generator, list(history), question)
    rows = excerpts(spark, chunks, embedder.embed([searched], "query")[0], cutoff, **scope).orderBy("label").collect()  # eight at most
    if not rows:
        yield {"type": "abstention", "message": "no passage answers this"}
        return
    yield {"type": "status", "stage": "writing", "retrieval_query": searched}
    by_label, parser, numbers, spans, told = {r["label"]: r for r in rows}, ClaimParser(), {}, {}, 0
    try:
        for fragment in generator.stream(prompt(question, rows, list(history))):
            for claim in parser.feed(fragment):
                cited = []
                for source in claim.get("sources") or []:
                    label = str(source.get("id", "")).strip().upper().removeprefix("S")
                    if label.isascii() and label.isdigit() and int(label) in by_label:
                        number = numbers.setdefault(int(label), len(numbers) + 1)
                        if number not in cited:
                            cited.append(number)
                        span = grounding.find_quote(by_label[int(label)]["text"], source.get("quote"))
                        if span:
                            spans.setdefault(int(label), []).append(span)
                text = claim.get("text")
                if isinstance(text, str) and text.strip() and cited:
                    yield {"type": "claim", "index": told, "text": text.strip(), "citations": cited}
                    told += 1
    except ValueError:
        pass  # what was told before the fault stands
    if not told:
        yield {"type": "abstention" if parser.finished else "error", "message": "no supported answer"}
        return
    citations = []
    for label, number in numbers.items():
        text = by_label[label]["text"]
        citations.append({"number": number, "chunk_id": by_label[label]["chunk_id"], "quotes": [text[a:b] for a, b in spans.get(label, [])], "spans": spans.get(label, [(0, len(text))])})
    yield {"type": "citations", "citations": citations}
    yield {"type": "completed"}
