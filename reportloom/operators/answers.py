"""Model answers: prompts, providers, and the parser of templated answers into lesion rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import UNKNOWN, require, strip
from ..sources.store import read_text

NO_LESION = "No lesions mentioned"


@dataclass(frozen=True)
class Prompt:
    """A prompt's fields, the other names that answers use for them, and its text (by default one that asks for the fields)."""

    fields: tuple[str, ...]
    aliases: dict[str, str] = field(default_factory=dict)
    text: str = ""

    @property
    def asked(self) -> str:
        return self.text or f"List each lesion of the report on a line: lesion n: {' '.join(f'{f.replace("_", " ")} = _;' for f in self.fields)}"


_BASE = ("type", "certainty", "size", "structure", "lateralization")
# The types, the marks for what isn't told, and the words that stand for a size, a side, a degree and a certainty.
TYPES = {"ICH": "in the brain tissue", "IVH": "in the ventricles", "SAH": "subarachnoid", "SDH": "subdural", "EDH": "epidural", "PHE": "edema around a hematoma"}
SIZES = ("tiny", "small", "large")
SIDES = ("Left", "Right", "Bilateral", "Median")
SIDES_AS_REPORTED = ("Gauche", "Droit", "Bilateral", "Median")
DEGREES = ("Mild", "Moderate", "Severe")
DEGREES_AS_REPORTED = ("Leger", "Modere", "Severe/Marque")
CERTAINTIES = {"certain": "stated plainly", "high": "probable", "low": "suspected, or a faint trace"}
ARTIFACTS = ("drain", "embolization", "movement", "metal")


def _line(fields: tuple[str, ...], n: int | str = "n") -> str:
    return f"lesion {n}: {' '.join(f'{f} = _;' for f in fields)}"


def _told(words: dict[str, str]) -> str:
    return ", ".join(f"{k} ({v})" for k, v in words.items())


def _rules(fields: tuple[str, ...], sides: tuple[str, ...], degrees: tuple[str, ...], english: bool, one_structure: bool, why: bool) -> str:
    """The text of a prompt: what its fields may hold, and what to answer where there is nothing."""
    degree = f"for PHE one of {', '.join(degrees)}"
    known = {
        "type": f"one of {_told(TYPES)}.",
        "certainty": f"one of {_told(CERTAINTIES)}.",
        "size": f"the dimensions with the report's unit, cm or mm (mm where it names none), as in 4.3 x 2.0 cm; in words without numbers one of {', '.join(SIZES)}" + ("." if "severity_phe" in fields else f"; {degree}."),
        "structure": "the place alone, without its side: the lobe or region, for IVH the ventricle or horn, for PHE the region that it surrounds.",
        "lateralization": f"one of {', '.join(sides)}.",
        "ventricle_details": "for IVH the part of the ventricles (a horn, V3, V4); for ICH only a part that it extends into.",
        "severity_phe": f"{degree}; U for other types.",
        "artifacts": f"those of {', '.join(ARTIFACTS)} that the report names, or None.",
    }
    out = ["Write down every intracranial hemorrhage, and every edema around one, that the radiology report below states, each on a line of this form:", _line(fields, 1), _line(fields, 2), "", "Fields:"]
    out += [f"- {f}: {known[f]}" for f in fields]
    out += ["", "Rules:", f"- Separate foci are separate lines{'; so are the structures of one lesion, one a line' if one_structure else ''}.", f"- Write {UNKNOWN} in a field that the report says nothing about; guess nothing."]
    out.append("- The report is in French; " + ("translate everything that you write into English." if english else "types are the English letters above, places stay in French."))
    if why:
        out.append("- Below the lines, say which sentences of the history, findings and impression each line comes from.")
    out.append(f"- If you are sure that there is neither, answer '{NO_LESION}.'" + (" and say why." if why else ""))
    return "\n".join(out)


def _prompt(fields: tuple[str, ...], aliases: dict[str, str] | None = None, **rules) -> Prompt:
    return Prompt(fields, aliases or {}, _rules(fields, **rules))


_TEMPLATE = _line(_BASE)
# The fields of each prompt, and names that stand for them. The texts are our own.
PROMPTS = {
    1: _prompt((*_BASE, "ventricle_details", "severity_phe", "artifacts"), {"ventricle details": "ventricle_details", "ventricle_detail": "ventricle_details", "severity phe": "severity_phe"}, sides=SIDES_AS_REPORTED, degrees=DEGREES_AS_REPORTED, english=False, one_structure=False, why=False),
    2: _prompt((*_BASE, "artifacts"), sides=SIDES, degrees=DEGREES, english=True, one_structure=True, why=False),
    3: _prompt(_BASE, sides=SIDES, degrees=DEGREES, english=True, one_structure=True, why=True),
    4: Prompt(_BASE, text=f"Read the report twice. First find every hemorrhage (ICH, IVH, SAH, SDH, EDH) and edema (PHE) that it states, then write one line for each: {_TEMPLATE} Write U where the report doesn't say, and 'No lesions mentioned' where there is none."),
    5: Prompt(_BASE, text=f"Write one line for each lesion of the report, as in: lesion 1: type = ICH; certainty = certain; size = 2 x 3 cm; structure = frontal; lateralization = left; - the form is {_TEMPLATE}"),
}


def load_prompts(spark: SparkSession, path: str) -> dict[int, Prompt]:
    """A deployment's prompts from a JSON file: {id: {"text": ..., "fields": [...], "aliases": {...}}}. What a known id leaves
    out is as here; a new id needs fields."""
    import json

    out = dict(PROMPTS)
    for key, given in json.loads(read_text(spark, path)).items():
        base = PROMPTS.get(int(key))
        if base is None and "fields" not in given:
            raise ValueError(f"prompt {key} has no fields")
        out[int(key)] = Prompt(tuple(given.get("fields") or base.fields), given.get("aliases", base.aliases if base else {}), given.get("text", base.text if base else ""))
    return out


SYSTEM = "You read radiology reports and answer in the given template only."


def prompt_of(prompt_id: int, prompts: dict[int, Prompt] = PROMPTS) -> Prompt:
    if prompt_id not in prompts:
        raise ValueError(f"unknown prompt_id: {prompt_id}")
    return prompts[prompt_id]


def messages(report: Column, prompt_id: int, prompts: dict[int, Prompt] = PROMPTS) -> Column:
    """array<struct<role, content>> for a chat model."""
    text = prompt_of(prompt_id, prompts).asked
    turn = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(turn("system", F.lit(SYSTEM)), turn("user", F.concat(F.lit(text + "\n\nReport:\n"), report)))


class AnswerProvider(Protocol):
    """Answers conversations; one is made per partition."""

    def __call__(self, conversation: list[dict[str, str]]) -> str: ...


def answered(reports: DataFrame, prompt_id: int, provider: Callable[[], AnswerProvider], prompts: dict[int, Prompt] = PROMPTS) -> DataFrame:
    """``reports`` with "DNN Answer". A task that runs again calls again: write the result once and parse from there."""
    require(reports, "ID", "Report")
    asked = reports.withColumn("_ask", messages(F.col("Report").cast("string"), prompt_id, prompts))
    schema = reports.withColumn("DNN Answer", F.lit("")).schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        answer = None
        for batch in batches:
            answer = answer or provider()
            told = [answer([{"role": t["role"], "content": t["content"]} for t in map(_plain, talk)]) for talk in batch["_ask"]]
            yield batch.drop(columns="_ask").assign(**{"DNN Answer": told})

    return asked.mapInPandas(run, schema)


def _plain(turn) -> dict:
    return turn if isinstance(turn, dict) else turn.asDict()


@dataclass
class HttpProvider:
    """An OpenAI-style chat endpoint; the model is the first that the server lists. Certificates are checked."""

    base_url: str
    timeout: float = 6000

    def model(self) -> str:
        self._model = getattr(self, "_model", None) or self._get("/models")["data"][0]["id"]
        return self._model

    def __call__(self, conversation: list[dict[str, str]]) -> str:
        body = {"model": self.model(), "messages": conversation, "temperature": 0, "top_p": 1}
        return self._get("/chat/completions", body)["choices"][0]["message"]["content"]

    def _get(self, path: str, body: dict | None = None) -> dict:
        import json
        from urllib.request import Request, urlopen

        data = None if body is None else json.dumps(body).encode()
        with urlopen(Request(self.base_url + path, data, {"Content-Type": "application/json"}), timeout=self.timeout) as reply:
            return json.load(reply)


@dataclass
class RecordedProvider:
    """Answers by report text: for tests and replays."""

    answers: dict[str, str]

    def __call__(self, conversation: list[dict[str, str]]) -> str:
        return self.answers[conversation[-1]["content"].partition("\n\nReport:\n")[2]]


def _key(raw: Column) -> Column:
    """The field that an item's left side names, spelled with spaces."""
    key = F.replace(F.lower(strip(F.substring_index(raw, ":", -1))), F.lit("_"), F.lit(" "))
    key = F.regexp_replace(key, r"(?U)^\d+\.?\s*", "")
    key = strip(F.regexp_replace(key, r"(?U)^(?:lesion\s*\d*|\*|-)\s*", ""))
    return F.regexp_replace(key, r"(?U)\s+", " ")


def _named(key: Column, aliases: dict[str, str]) -> Column:
    named = key
    for other, name in aliases.items():
        named = F.when(key == other, F.lit(name)).otherwise(named)
    return F.replace(named, F.lit(" "), F.lit("_"))


def lesions(answer: Column, prompt: Prompt) -> Column:
    """array<struct<fields>> of an answer's accepted lines, in order."""
    text = strip(answer)
    none = F.contains(F.substring(F.lower(text), 1, 100), F.lit(NO_LESION.lower()))

    def line_items(line: Column) -> Column:
        items = F.filter(F.split(line, ";"), lambda i: F.contains(i, F.lit("=")))
        at = lambda i: F.position(F.lit("="), i)
        pairs = F.transform(items, lambda i: F.struct(_key(F.substring(i, F.lit(1), at(i) - 1)).alias("k"), strip(F.substring(i, at(i) + 1, F.length(i))).alias("v")))
        return F.transform(pairs, lambda kv: F.struct(_named(kv["k"], prompt.aliases).alias("k"), kv["v"].alias("v")))  # a key is made once, and compared with each alias

    def last(items: Column, name: str) -> Column:
        return F.try_element_at(F.filter(items, lambda kv: kv["k"] == name), F.lit(-1))["v"]

    def filled(items: Column) -> Column:
        return F.struct(*(F.coalesce(last(items, f), F.lit(UNKNOWN)).alias(f) for f in prompt.fields))

    lines = F.transform(F.split(F.when(none, F.lit("")).otherwise(text), "\n"), lambda x: strip(F.replace(x, F.lit("**"), F.lit(""))))
    held = F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("type")) & F.contains(x, F.lit("=")) & F.contains(x, F.lit(";")))
    return F.filter(F.transform(F.transform(held, line_items), filled), lambda r: ~r["type"].isin("", UNKNOWN))


def parse_answers(answers: DataFrame, prompt_id: int, prompts: dict[int, Prompt] = PROMPTS, answer: str = "DNN Answer") -> DataFrame:
    """``answers`` with "Lesion Index" and the prompt's fields: a row a lesion, numbered from 1, or one row numbered 0 for
    a report without any. A null answer has none."""
    prompt = prompt_of(prompt_id, prompts)
    kept = [c for c in answers.columns if c != "Lesion Index" and c not in prompt.fields]
    rows = answers.select(*(F.col(f"`{c}`") for c in kept), F.posexplode_outer(lesions(F.coalesce(F.col(f"`{answer}`"), F.lit("")), prompt)).alias("_at", "_lesion"))
    value = lambda f: F.coalesce(F.col(f"_lesion.{f}"), F.lit(NO_LESION if f == "type" else UNKNOWN)).alias(f)
    lead = ["ID"] if "ID" in kept else []
    return rows.select(*lead, F.coalesce(F.col("_at") + 1, F.lit(0)).alias("Lesion Index"), *map(value, prompt.fields), *(F.col(f"`{c}`") for c in kept if c not in lead))
