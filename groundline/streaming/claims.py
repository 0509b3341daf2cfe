"""Claims taken out of an answer while it is still being written: an incremental parser, as batch and as stateful stream."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "answer_id string, claim int, value string, finished boolean"


class ClaimParser:
    """Feeds on fragments of a JSON text and gives the objects of its "claims" array as each one closes.

    Each character is looked at once: the state holds the depth, whether a string is open, and the object so far.
    """

    def __init__(self, state: dict | None = None):
        s = state or {}
        self.head, self.inside, self.finished = s.get("head", ""), s.get("inside", False), s.get("finished", False)
        self.depth, self.quoted, self.escaped, self.held = s.get("depth", 0), s.get("quoted", False), s.get("escaped", False), s.get("held", "")

    def state(self) -> dict:
        return dict(self.__dict__)

    def feed(self, fragment: str) -> list[dict]:
        out: list[dict] = []
        if self.finished:
            return out
        if not self.inside:
            self.head += fragment
            key = self.head.find('"claims"')
            start = self.head.find("[", key) if key >= 0 else -1
            if start < 0:
                return out
            fragment, self.head, self.inside = self.head[start + 1 :], "", True
        for c in fragment:
            if self.depth:
                self.held += c
                if self.escaped:
                    self.escaped = False
                elif self.quoted and c == "\\":
                    self.escaped = True
                elif c == '"':
                    self.quoted = not self.quoted
                elif not self.quoted and c in "{}":
                    self.depth += 1 if c == "{" else -1
                    if not self.depth:
                        out.append(json.loads(self.held))
                        self.held = ""
            elif c == "{":
                self.depth, self.held = 1, c
            elif c == "]":
                self.finished = True
                break
            elif not c.isspace() and c != ",":
                raise ValueError("a claim must be an object")
        return out


def _rows(answer: str, start: int, claims: list[dict], finished: bool) -> pd.DataFrame:
    values = [json.dumps(c, ensure_ascii=False) for c in claims]
    rows = pd.DataFrame({"answer_id": [answer] * len(values), "claim": range(start, start + len(values)), "value": values, "finished": [finished] * len(values)})
    return rows.astype({"answer_id": "object", "claim": "int32", "value": "object", "finished": "bool"})


def parse_answers(fragments: DataFrame) -> DataFrame:
    """Claims of whole answers (answer_id, seq, fragment). An answer is one response of a model, so its fragments fit into a row."""
    whole = fragments.groupBy("answer_id").agg(F.array_distinct(F.sort_array(F.collect_list(F.struct("seq", "fragment")))).alias("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for answer, parts in zip(batch.column("answer_id").to_pylist(), batch.column("parts").to_pylist()):
                parser, found, last = ClaimParser(), [], None
                try:
                    for part in parts:
                        if part["seq"] != last:
                            found += parser.feed(part["fragment"] or "")
                        last = part["seq"]
                except ValueError:
                    pass  # what closed before the fault stands, and the answer is not finished
                rows += [(answer, n, json.dumps(c, ensure_ascii=False), parser.finished) for n, c in enumerate(found)]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 4, kinds)], ["answer_id", "claim", "value", "finished"])

    return whole.mapInArrow(run, OUTPUT)


class ClaimStream(StatefulProcessor):
    """The parser with its state in the state store. Fragments that come early wait until the ones before them have come."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.saved = handle.getValueState("parser", "json string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        state = json.loads(self.saved.get()[0]) if self.saved.exists() else {"next": 0, "early": {}, "claims": 0, "parser": {}, "broken": False}
        for batch in rows:
            for seq, fragment in zip(batch["seq"], batch["fragment"]):
                if int(seq) >= state["next"]:
                    state["early"][str(int(seq))] = fragment or ""
        parser, found = ClaimParser(state["parser"]), []
        while not state["broken"] and str(state["next"]) in state["early"]:
            try:
                found += parser.feed(state["early"].pop(str(state["next"])))
            except ValueError:
                state["broken"] = True
            state["next"] += 1
        start = state["claims"]
        state["claims"] += len(found)
        state["parser"] = parser.state()
        self.saved.update((json.dumps(state),))
        yield _rows(key[0], start, found, parser.finished)

    def close(self) -> None:
        pass


def claim_stream(fragments: DataFrame) -> DataFrame:
    """The streaming form of parse_answers; needs the RocksDB state store provider."""
    return fragments.groupBy("answer_id").transformWithStateInPandas(ClaimStream(), OUTPUT, "Append", "None")


def validated(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """(answer_id, claim, text, sources) of usable claims: text that is not blank and labels of evidence (answer_id, label), each once, in order."""
    parsed = claims.select("answer_id", "claim", F.from_json("value", "text string, sources array<struct<id: string, quote: string>>").alias("c"))
    labels = F.transform("c.sources", lambda s: F.try_element_at(F.regexp_extract_all(F.upper(F.trim(s["id"])), F.lit(r"^S?(\d+)$"), 1), F.lit(1)).cast("int"))
    known = evidence.groupBy("answer_id").agg(F.collect_set(F.col("label").cast("int")).alias("known"))
    both = parsed.join(known, "answer_id")
    sources = F.array_distinct(F.filter(labels, lambda n: F.array_contains("known", n)))
    return both.select("answer_id", "claim", F.trim("c.text").alias("text"), sources.alias("sources")).filter((F.col("text") != "") & (F.size("sources") > 0))
