"""Prompts, chat templates and transcripts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom.functions import text as T

# Template pieces (opening of a text, turn header, end of turn, header of the next user turn).
CHAT = {
    "llama": ("<|begin_of_text|>", ("<|start_header_id|>", "<|end_header_id|>\n\n"), "<|eot_id|>", "<|start_header_id|>user<|end_header_id|>\n\n"),
    "qwen": ("", ("<|im_start|>", "\n"), "<|im_end|>\n", "<|im_start|>user\n"),
}
QWEN_SYSTEM = "You are Qwen, created by Alibaba Cloud. You are a helpful assistant."
ENDCONV = "<|endconversation|>"
INTENT_START = "You are a user chatting with an assistant language model to"


def intent_history(conv: Column) -> Column:
    """``<role>: content`` lines."""
    return F.array_join(F.transform(conv, lambda t: F.concat(F.lit("<"), t["role"], F.lit(">: "), t["content"])), "\n")


# The texts of the intent prompt, with the places of shots and conversation.
INTENT_TASK = (
    "You are given the conversation history between a user and assistant model and your task is to create a summary of the user's intent from the conversation.\n\n"
    "Your summary should be structured to define what the high level intent of the user is, but should not go into specific details.\n\n"
    'Format the summary to start with "You are a user chatting with an assistant language model to"'
)
INTENT_SHOT = "Example {number}:\n\nConversation History:\n{history}\n\nIntent Summary:\n{intent}\n\n"
INTENT_ASK = ("Now generate a summary of the user intent for the following conversation:\n\n", "\n\nReply with only the intent summary and nothing else.")
# The texts of the judge's prompt, before problem, solution, answer and response.
JUDGE_PARTS = ("## Original problem\n", "\n\n## Reference solution\n", "\n\n## Reference answer\n", "\n\n## Assistant response\n")


def intent_prompt(conv: Column, shots: list[tuple[str, str]], task: str = INTENT_TASK) -> Column:
    """Few-shot intent prompt around a conversation; ``shots`` are (history, intent). All but the conversation is one literal."""
    shown = "".join(INTENT_SHOT.format(number=k, history=h, intent=i) for k, (h, i) in enumerate(shots, 1))
    opening, closing = INTENT_ASK
    return F.concat(F.lit(f"{task}\n\n{shown}{opening}"), intent_history(conv), F.lit(closing))


def judge_prompt(problem: Column, solution: Column, answer: Column, response: Column) -> Column:
    """The judge's prompt for one assistant turn; NULL where a part is NULL."""
    return F.concat(*[x for head, part in zip(JUDGE_PARTS, (problem, solution, answer, response)) for x in (F.lit(head), part)])


def render_turn(role: Column, content: Column, family: str) -> Column:
    _, (left, right), end, _ = CHAT[family]
    body = T.strip(content) if family == "llama" else content
    return F.concat(F.lit(left), role, F.lit(right), body, F.lit(end))


def render_chat(conv: Column, family: str, next_user: bool = True) -> Column:
    """A conversation in a chat template; qwen adds its system turn where the first turn is none."""
    bos, _, _, header = CHAT[family]
    body = F.array_join(F.transform(conv, lambda t: render_turn(t["role"], t["content"], family)), "")
    if family == "qwen":
        system = render_turn(F.lit("system"), F.lit(QWEN_SYSTEM), family)
        body = F.concat(F.when(F.get(conv, F.lit(0))["role"].eqNullSafe(F.lit("system")), F.lit("")).otherwise(system), body)
    return F.concat(F.lit(bos), body, F.lit(header if next_user else ""))


def parse_transcript(text: Column) -> Column:
    """Messages of a ``\\n\\nHuman: .. \\n\\nAssistant: ..`` transcript, contents stripped; text before the first marker is dropped."""
    marker = r"\n\n(Human|Assistant): "
    roles = F.regexp_extract_all(text, F.lit(marker), F.lit(1))

    def paired(bodies: Column) -> Column:
        return F.transform(
            roles,
            lambda r, i: F.struct(
                F.when(r == "Human", F.lit("user")).otherwise(F.lit("assistant")).alias("role"), T.strip(F.get(bodies, i + 1)).alias("content")
            ),
        )

    return T.let(F.split(text, marker, -1), paired)


def common_prefix_length(a: Column, b: Column, steps: int = 31) -> Column:
    """Length of the longest common prefix, by halving: equality of prefixes is monotone."""
    pair = F.struct(F.lit(0).alias("low"), F.least(F.char_length(a), F.char_length(b)).alias("high"))

    def search(texts: Column) -> Column:
        def halve(acc: Column, _: Column) -> Column:
            mid = F.floor((acc["low"] + acc["high"] + 1) / 2).cast("int")
            same = F.substring(texts["a"], F.lit(1), mid) == F.substring(texts["b"], F.lit(1), mid)
            return F.struct(F.when(same, mid).otherwise(acc["low"]).alias("low"), F.when(same, acc["high"]).otherwise(mid - 1).alias("high"))

        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), pair, halve, lambda acc: acc["low"])

    return T.let(F.struct(a.alias("a"), b.alias("b")), search)


def parse_preference_pair(chosen: Column, rejected: Column) -> Column:
    """Shared history as messages, then the whole rest of ``chosen`` as one assistant turn.

    The pair parts after the last ``\\n\\nAssistant:`` of the common prefix; an error where there is none.
    """
    marker = "\n\nAssistant:"

    def cut(shared: Column) -> Column:
        found = F.char_length(shared) - F.char_length(F.substring_index(shared, marker, -1)) - len(marker)
        return F.when(F.instr(shared, marker) > 0, found).otherwise(
            F.raise_error(F.lit("chosen and rejected part before any assistant turn")).cast("int"))

    def parsed(boundary: Column) -> Column:
        answer = T.strip(F.substring(chosen, boundary + len(marker) + 1, F.char_length(chosen)))
        last = F.array(F.struct(F.lit("assistant").alias("role"), answer.alias("content")))
        return F.concat(parse_transcript(F.substring(chosen, F.lit(1), boundary)), last)

    shared = F.substring(chosen, F.lit(1), common_prefix_length(chosen, rejected))
    return T.let(T.let(shared, cut), parsed)


def fenced_blocks(text: Column) -> Column:
    """Bodies of fenced python (or unmarked) code blocks."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```(?:python|py)?[ \t]*\n(.*?)```"), F.lit(1))
