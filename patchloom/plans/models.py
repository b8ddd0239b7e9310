"""Text models as map stages: a protocol, retries with back-off, and a deterministic stand-in that needs no network."""

from __future__ import annotations

import hashlib
import json
import os
import subprocess
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS = 5
#: Seconds before the second attempt, doubled for each further one, and the most that is waited.
FIRST_WAIT, LONGEST_WAIT = 5.0, 60.0


class TextModel(Protocol):
    """Answers a task on named inputs. Must be picklable; loaded where it runs."""

    def complete(self, task: str, inputs: dict[str, str]) -> str: ...


class ModelFailure(RuntimeError):
    """A call that may succeed if it is made again: a limit was hit, or the back-end is away."""


def ask(model: TextModel, task: str, inputs: dict[str, str], attempts: int = ATTEMPTS, sleep: Callable[[float], object] = time.sleep) -> str | None:
    """The first non-empty answer; None if every attempt is empty or fails.

    After a failed call the next one waits, twice as long each time; an empty answer is asked for again at once. Other errors than
    a ModelFailure are mistakes of the caller and are raised.
    """
    wait = FIRST_WAIT
    for attempt in range(attempts):
        try:
            answer = model.complete(task, inputs)
        except ModelFailure:
            if attempt + 1 < attempts:
                sleep(wait)
            wait = min(2 * wait, LONGEST_WAIT)
            continue
        if answer:
            return answer
    return None


SEPARATOR = "\x1f"


def input_hash(inputs: dict[str, str]) -> int:
    """32 bits of the MD5 of all inputs, in the order of their names."""
    return int(hashlib.md5(SEPARATOR.join(str(inputs[k]) for k in sorted(inputs)).encode()).hexdigest()[:8], 16)


def hash_sql(*parts: str) -> str:
    """input_hash as SQL, of expressions in the order of the inputs' names."""
    return f"('0x' || left(md5({f' || chr(31) || '.join(parts)}), 8))::BIGINT"


LEVELS = ("High", "Medium", "Low", "Inconsistent")
GRADES = ("SynPatchEq", "SemEq", "Plausible", "Incorrect")


class StandIn:
    """Answers that follow from a hash of the inputs alone, in the forms that the parsers expect, now and then unreadable."""

    def complete(self, task: str, inputs: dict[str, str]) -> str:
        return getattr(self, f"_{task}")(input_hash(inputs), inputs)

    def _candidates(self, h: int, x: dict[str, str]) -> str:
        if h % 11 < 2:
            return ("no idea", '{"sources": [broken')[h % 11]
        found = {"sources": [{"name": "a", "lines": [1 + h % 7, "x", 1 + h % 5]}], "sinks": [{"name": "b", "lines": [h % 3]}]}
        return f"Here: ```json {json.dumps(found)} ```"

    def _elements(self, h: int, x: dict[str, str]) -> str:
        found = [{"name": f"v{h % 9}", "lines": [1 + h % 4, 2 + h % 4], "type": "variable", "relevance": "high"}]
        return "nothing" if h % 6 == 0 else json.dumps({"key_elements": found})

    def _hypothesise(self, h: int, x: dict[str, str]) -> str:
        causes: list[dict] = []
        for i in range(1 + h % 7):
            entry = {"specific": f"cause {(h + i) % 50}", "logic": f"logic {i}", "effect": f"effect {(h + i) % 3}", "key_variables": [f"v{i}", "w"], "lines": [1 + (h + i) % 5]}
            if i == 1 and h % 4 == 0:
                entry["lines"] = ["all"]
            if i == 2 and h % 3 == 0:
                del entry["specific"]
            causes.append(entry)
        return "I see none" if h % 19 == 0 else f"I see: ```json {json.dumps({'root_causes': causes})} ```"

    def _refine(self, h: int, x: dict[str, str]) -> str:
        fields = {"cause": f"refined {x['cause']}", "logic": f"l{h % 5}", "effect": f"e{h % 6}", "flow": f"f{h % 7}", "conditions": f"c{h % 4}", "confidence": LEVELS[h % 3]}
        return "?" if h % 5 == 0 else json.dumps(fields)

    def _consistency(self, h: int, x: dict[str, str]) -> str:
        return "unsure" if h % 13 == 0 else "so " + json.dumps({"level": LEVELS[h % 4], "confidence": (h // 4 % 11) / 10, "explanation": f"x{h % 8}"})

    def _sections(self, **texts: str) -> str:
        return "\n".join(f"{k}_START:\n{v}\n{k}_END:" for k, v in texts.items())

    def _suggest(self, h: int, x: dict[str, str]) -> str:
        if h % 7 == 0:
            return "nothing to suggest"
        parts = {"PATCH_DIFF": f"+ fix {h % 1000}", "KEY_VARIABLES": f"a{h % 3}, , b"}
        return self._sections(**parts, **({"REPAIR_STRATEGY": f"strategy {h % 40}"} if h % 5 else {}))

    def _direct(self, h: int, x: dict[str, str]) -> str:
        return self._suggest(h, x) + "\n" + (self._sections(VULNERABILITY_ANALYSIS=f"analysis {h % 30}") if h % 4 else "")

    def _synthesise(self, h: int, x: dict[str, str]) -> str:
        if h % 9 == 0:
            return self._sections(REPAIR_STRATEGY="no patch")
        names = ("SPECIFIC_CAUSE", "LOGIC", "EFFECT", "PRE_STATE", "POST_STATE", "KEY_VARIABLES", "NEW_IDEA")
        return self._sections(PATCH_DIFF=f"+ merged {h % 100}", REPAIR_STRATEGY=f"joint {h % 10}", **{n: f"{n.lower()} {h % 6}" for n in names})

    def _judge(self, h: int, x: dict[str, str]) -> str:
        return ("true", "false", "TRUE, I think")[h % 3]

    def _grade(self, h: int, x: dict[str, str]) -> str:
        return "hard to say" if h % 10 == 0 else json.dumps({"class": GRADES[h % 4], "explanation": f"g{h % 5}", "confidence": (h % 11) / 10})

    def _merge_condition(self, h: int, x: dict[str, str]) -> str:
        return "None" if h % 5 == 0 else f"both {h % 20}"

    def _entails(self, h: int, x: dict[str, str]) -> str:
        return "I cannot tell" if h % 7 == 0 else f"Well: {json.dumps({'answer': 'Yes' if h % 2 else 'no'})}"

    def _same_domain(self, h: int, x: dict[str, str]) -> str:
        return json.dumps({"answer": "yes" if h % 3 else "no"})

    def _explain(self, h: int, x: dict[str, str]) -> str:
        return f"because {h % 12}"

    def _consensus(self, h: int, x: dict[str, str]) -> str:
        return f"in short {h % 12}"

    def _zero_shot(self, h: int, x: dict[str, str]) -> str:
        return "I would not" if h % 8 == 0 else f"Try\n```c\nreturn {h % 100};\n```\nor\n```\nother\n```"

    def _strategy(self, h: int, x: dict[str, str]) -> str:
        if h % 17 == 0:
            return ""
        return f"Vulnerability Source (Precise): s{h % 3}\nCWE-Specific Repair Strategy: specific {h % 100}\nAbstract Repair Strategy: after {x['feedback'] or 'nothing'}"

    def _apply(self, h: int, x: dict[str, str]) -> str:
        return ("not json", json.dumps({"patch_diff": "", "repair_strategy": "r"}))[h % 23] if h % 23 < 2 else json.dumps({"patch_diff": f"+ {x['strategy']}", "repair_strategy": ""})

    def _verdict(self, h: int, x: dict[str, str]) -> str:
        return "Result: correct" if h % 2 else f"Result: Incorrect\nFeedback: try {h % 10}"


class Constant:
    """The back-end for dry runs: one answer to everything."""

    def __init__(self, answer: str = "debug") -> None:
        self.answer = answer

    def complete(self, task: str, inputs: dict[str, str]) -> str:
        return self.answer


class Command:
    """A local back-end: a program that reads {"task", "inputs"} as JSON and prints its answer. It is started for each call."""

    def __init__(self, arguments: list[str], seconds: float = 600) -> None:
        self.arguments, self.seconds = arguments, seconds

    def complete(self, task: str, inputs: dict[str, str]) -> str:
        asked = json.dumps({"task": task, "inputs": inputs})
        try:
            done = subprocess.run(self.arguments, input=asked, capture_output=True, text=True, timeout=self.seconds, check=True)
        except (subprocess.CalledProcessError, subprocess.TimeoutExpired) as e:
            raise ModelFailure(str(e)) from e
        return done.stdout.strip()


class Guarded:
    """A back-end whose answers may be withheld: one that blocked() names a reason for comes back empty."""

    def __init__(self, model: TextModel, blocked: Callable[[str], str | None]) -> None:
        self.model, self.blocked = model, blocked

    def complete(self, task: str, inputs: dict[str, str]) -> str:
        answer = self.model.complete(task, inputs)
        return "" if self.blocked(answer) else answer


def samples(model: TextModel, task: str, inputs: dict[str, str], n: int) -> list[str]:
    """Up to n answers to one task, told apart by the input sample; empty ones are left out."""
    found = [ask(model, task, {**inputs, "sample": str(i)}) for i in range(n)]
    return [x for x in found if x]


def credential(provider: str, given: str | None = None) -> str:
    """The key that was given, else the one in <PROVIDER>_API_KEY; an error if there is none. Never stored."""
    key = given or os.environ.get(f"{provider.upper()}_API_KEY")
    if not key:
        raise ValueError(f"no key for {provider}: give one or set {provider.upper()}_API_KEY")
    return key


#: Back-ends by name; more are added by whoever has them.
BACKENDS: dict[str, Callable[[], TextModel]] = {"stand-in": StandIn, "debug": Constant}


def backend(name: str) -> TextModel:
    if name not in BACKENDS:
        raise ValueError(f"no back-end {name!r}; known: {', '.join(sorted(BACKENDS))}")
    return BACKENDS[name]()


def prompt(role: str, inputs: dict[str, Column], wanted: tuple[str, ...]) -> Column:
    """The text of a task: a role, one section for each input that is not blank, and the sections that the answer must have."""
    parts = [F.lit(role)]
    parts += [F.when(F.trim(F.coalesce(c, F.lit(""))) != "", F.concat(F.lit(f"### {name}\n"), c)) for name, c in inputs.items()]
    parts += [F.lit("Answer with: " + ", ".join(f"{w}_START: ... {w}_END:" for w in wanted))] if wanted else []
    return F.concat_ws("\n\n", *parts)


def model_map(df: DataFrame, model: TextModel, task: str, inputs: dict[str, str], out: str, parallel: int = 1) -> DataFrame:
    """df with the model's answer to task in column out; inputs maps the task's names to columns. No shuffle.

    A task makes up to parallel calls at a time; answers stay with their rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(parallel) if parallel > 1 else _Serial() as pool:
            for pdf in batches:
                columns = {k: pdf[c].fillna("").astype(str).tolist() for k, c in inputs.items()}
                calls = [{k: v[i] for k, v in columns.items()} for i in range(len(pdf))]
                yield pdf.assign(**{out: list(pool.map(lambda x: ask(model, task, x), calls))})

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", `{out}` string"
    return df.mapInPandas(run, schema)


class _Serial:
    """A pool of no threads."""

    map = staticmethod(map)

    def __enter__(self) -> _Serial:
        return self

    def __exit__(self, *_: object) -> None:
        return None


def feedback_loop(df: DataFrame, model: TextModel, key: str, code: str, max_iterations: int = 2) -> DataFrame:
    """key, attempts, status, verdicts, strategy: strategy, application and verdict until it is right, at most max_iterations + 1 rounds.

    An empty strategy and an unreadable or empty patch end the row as failed; an empty repair strategy does not. A blank code
    never starts. strategy is the last one's specific part.
    """
    kinds = dict(df.dtypes)

    def one(text: str) -> tuple[int, str, str, str]:
        if not text.strip():
            return 0, "failed", "", ""
        feedback, verdicts, specific = "", [], ""
        for attempt in range(1, max_iterations + 2):
            answer = ask(model, "strategy", {"code": text, "feedback": feedback, "round": str(attempt)}, attempts=1)
            if answer is None:
                return attempt, "failed", ",".join(verdicts), specific
            specific = answer.partition("CWE-Specific Repair Strategy:")[2].partition("\n")[0].strip() or "N/A"
            try:
                patch = json.loads(ask(model, "apply", {"code": text, "strategy": specific}) or "")["patch_diff"]
            except (ValueError, KeyError):
                patch = ""
            if not patch:
                return attempt, "failed", ",".join(verdicts), specific
            said = ask(model, "verdict", {"patch": patch, "round": str(attempt)}) or ""
            right = said.lower().startswith("result: correct")
            verdicts.append("correct" if right else "incorrect")
            if right:
                return attempt, "success", ",".join(verdicts), specific
            feedback = said.partition("Feedback:")[2].strip() or "no feedback"
        return max_iterations + 1, "failed", ",".join(verdicts), specific

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [one(x if isinstance(x, str) else "") for x in pdf[code]]
            yield pd.DataFrame({key: pdf[key], "attempts": [r[0] for r in rows], "status": [r[1] for r in rows], "verdicts": [r[2] for r in rows], "strategy": [r[3] for r in rows]})

    return df.select(key, code).mapInPandas(run, f"{key} {kinds[key]}, attempts long, status string, verdicts string, strategy string")


def usage(answered: DataFrame, keys: list[str], prompt_column: str, answer: str) -> DataFrame:
    """Calls, and characters sent and received, by keys."""
    size = lambda c: F.sum(F.length(F.coalesce(F.col(c), F.lit("")))).cast("long")
    return answered.groupBy(*keys).agg(F.count("*").alias("calls"), size(prompt_column).alias("sent"), size(answer).alias("received"))
