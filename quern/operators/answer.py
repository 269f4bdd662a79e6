"""From retrieved chunks to an answer: context, sources, prompt, and an injected language model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.config import RetrievalConfig
from quern.functions.text import blank, strip

INSUFFICIENT = "There is not enough information in the indexed content to answer this confidently. Please rephrase the question or add context."
NO_PASSAGES = "(Retrieval found nothing for this question.)"
RULES = f"Instructions:\n- Ground every statement in the passages.\n- Cite sources by title and URL.\n- If evidence is missing, say so.\n- Otherwise answer: {INSUFFICIENT}\n"
SYSTEM = "Answer from the given passages alone. Cite them by title and URL, name conflicts between them, and say so if they don't hold the answer."


def context_blocks(found: DataFrame) -> DataFrame:
    """found (query_id, rank, title, url, section, relevance, text) with block, the text that a prompt shows of a chunk."""
    block = F.concat(
        F.lit("[Source "), F.col("rank").cast("string"), F.lit("] title="), blank("title"), F.lit("\nurl="), blank("url"), F.lit("\nsection="), blank("section"),
        F.lit("\nrelevance="), F.format_string("%.3f", F.col("relevance").cast("double")), F.lit("\ncontent:\n"), blank("text"),
    )
    return found.withColumn("block", block)


def context_budget(blocks: DataFrame, chars: int = RetrievalConfig().context_chars) -> DataFrame:
    """Blocks in rank order while their lengths together keep within chars; the first one always, none after an overflow."""
    running = F.sum(F.length("block")).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    return blocks.withColumn("chars", running).filter((F.col("rank") == 1) | (F.col("chars") <= chars))


def source_list(found: DataFrame) -> DataFrame:
    """(query_id, position, title, url, section, relevance): distinct sources, the first of each, by rank."""
    order = Window.partitionBy("query_id", "title", "url", "section").orderBy("rank")
    first = found.withColumn("nth", F.row_number().over(order)).filter("nth = 1")
    clamped = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("relevance")))
    position = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return first.select("query_id", position.alias("position"), "title", "url", "section", F.bround(clamped, 4).alias("relevance"))


def build_prompt(question: Column, context: Column, history: Column) -> Column:
    """history, passages, question and instructions; context: the blocks, joined by blank lines."""
    shown = F.when(blank(context) == "", F.lit(NO_PASSAGES)).otherwise(context)
    before = F.when(blank(history) == "", F.lit("")).otherwise(F.concat(F.lit("Follow-up context:\n"), history, F.lit("\n\n")))
    return F.concat(before, F.lit("Retrieved passages:\n"), shown, F.lit("\n\nUser question:\n"), blank(question), F.lit("\n\n" + RULES))


def prompts(queries: DataFrame, found: DataFrame, history: DataFrame | None = None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, prompt) of each question; history: (query_id, history)."""
    kept = context_budget(context_blocks(found), config.context_chars)
    joined = kept.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "block"))), lambda b: b["block"]), "\n\n").alias("context"))
    rows = queries.select("query_id", "question").join(joined, "query_id", "left")
    rows = rows.join(history, "query_id", "left") if history is not None else rows.withColumn("history", F.lit(""))
    return rows.select("query_id", build_prompt(F.col("question"), F.col("context"), F.col("history")).alias("prompt"))


def validate(message: str, conversation_id: str | None = None, top_k: int | None = None) -> str:
    """The stripped message, or ValueError: 1 to 4000 characters, an id of 128 at most, 1 to 20 results."""
    text = (message or "").strip()
    if not 1 <= len(text) <= 4000:
        raise ValueError("a message has 1 to 4000 characters")
    if conversation_id is not None and len(conversation_id) > 128:
        raise ValueError("a conversation id has 128 characters at most")
    if top_k is not None and not 1 <= top_k <= 20:
        raise ValueError("top_k is from 1 to 20")
    return text


def verdict(message: Column, conversation_id: Column | None = None, top_k: Column | None = None) -> Column:
    """`ok n` for a message of n characters that validate() takes, else what validate() says of it; a null id or number isn't given."""
    n = F.length(strip(blank(message)))
    out = F.when((n < 1) | (n > 4000), "a message has 1 to 4000 characters")
    if conversation_id is not None:
        out = out.when(F.length(conversation_id.cast("string")) > 128, "a conversation id has 128 characters at most")
    if top_k is not None:
        out = out.when(~top_k.between(1, 20), "top_k is from 1 to 20")
    return out.otherwise(F.concat(F.lit("ok "), n.cast("string")))


def answers(queries: DataFrame, found: DataFrame, complete: Callable[[str, str], str] | None = None, history: DataFrame | None = None, config: RetrievalConfig = RetrievalConfig()) -> DataFrame:
    """(query_id, refused, answer, n_sources) of each question of queries from what retrieval found for it.

    A question without sufficient context gets INSUFFICIENT and no sources, and the model isn't asked. The model answers the
    prompts of the others where they lie; without a model the first passage's first line stands in.
    """
    from quern.operators.retrieval import context_sufficient

    model = complete or extractive
    enough = context_sufficient(found, queries, config).select("query_id", "sufficient")
    asked = prompts(queries.join(enough.filter("sufficient"), "query_id", "left_semi"), found, history, config)

    @F.pandas_udf("string")
    def ask(prompts):
        return prompts.map(lambda p: model(SYSTEM, p))

    said = asked.select("query_id", ask("prompt").alias("said"))
    sources = source_list(found).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    rows = enough.join(said, "query_id", "left").join(sources, "query_id", "left")
    refused = ~F.col("sufficient")
    return rows.select("query_id", refused.alias("refused"), F.when(refused, INSUFFICIENT).otherwise(F.col("said")).alias("answer"), F.when(refused, 0).otherwise(F.coalesce("n", F.lit(0))).cast("int").alias("n_sources"))


class ServiceError(RuntimeError):
    """Retrieval or the language model failed; there is no answer."""


def extractive(system: str, prompt: str) -> str:
    """A stand-in for a language model: the first passage's content."""
    content = prompt.partition("content:\n")[2].strip()
    return content.splitlines()[0] if content else INSUFFICIENT


@dataclass
class Answerer:
    """One question to an answer. retrieve, fill_gaps and complete are injected; histories are kept by conversation."""

    retrieve: Callable[[str], list[dict]]
    sufficient: Callable[[list[dict], str], bool]
    complete: Callable[[str, str], str] = extractive
    fill_gaps: Callable[[str, list[dict]], list[dict]] | None = None
    config: RetrievalConfig = RetrievalConfig()
    histories: dict[str, list[tuple[str, str]]] = field(default_factory=dict)

    def expand(self, conversation_id: str | None, message: str) -> str:
        turns = self.histories.get(conversation_id or "", [])
        previous = turns[-1][0].strip() if turns else ""
        if not previous or previous.lower() == message.lower():
            return message
        return f"{message}\n\nPrevious question in this conversation: {previous}"

    def remember(self, conversation_id: str | None, message: str, answer: str) -> None:
        if conversation_id:
            self.histories[conversation_id] = [*self.histories.get(conversation_id, []), (message, answer)][-self.config.history_turns :]

    def ask(self, message: str, conversation_id: str | None = None) -> dict:
        message = validate(message, conversation_id)
        query = self.expand(conversation_id, message)
        try:
            chunks = self.retrieve(query)
        except Exception as e:
            raise ServiceError(f"retrieval failed: {type(e).__name__}") from e
        if self.fill_gaps and not self.sufficient(chunks, query):
            chunks = self.fill_gaps(query, chunks)
        if not self.sufficient(chunks, query):
            self.remember(conversation_id, message, INSUFFICIENT)
            return {"answer": INSUFFICIENT, "sources": []}
        blocks, total = [], 0
        for i, c in enumerate(chunks, 1):
            block = f"[Source {i}] title={c['title']}\nurl={c['url']}\nsection={c['section']}\nrelevance={c['relevance']:.3f}\ncontent:\n{c['text']}"
            if blocks and total + len(block) > self.config.context_chars:
                break
            blocks.append(block)
            total += len(block)
        turns = self.histories.get(conversation_id or "", [])
        history = f"Follow-up context:\nPrevious question: {turns[-1][0]}\nPrevious answer: {turns[-1][1][: self.config.answer_chars]}\n\n" if turns else ""
        prompt = f"{history}Retrieved passages:\n" + ("\n\n".join(blocks) or NO_PASSAGES) + f"\n\nUser question:\n{message}\n\n{RULES}"
        try:
            answer = self.complete(SYSTEM, prompt)
        except Exception as e:
            raise ServiceError(f"the language model failed: {type(e).__name__}") from e
        if not (answer or "").strip():
            raise ServiceError("the language model said nothing")
        self.remember(conversation_id, message, answer)
        sources = {(c["title"], c["url"], c["section"]): round(min(1.0, max(0.0, c["relevance"])), 4) for c in reversed(chunks)}
        return {"answer": answer, "sources": [{"title": t, "url": u, "section": s, "relevance": r} for (t, u, s), r in reversed(sources.items())]}
