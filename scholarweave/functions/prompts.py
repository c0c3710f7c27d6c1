"""Prompt text as column expressions over analysed questions (language, query_type, complexity, confidence)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scholarweave.functions.text import strip
from scholarweave.prompt_texts import BASE, BY_COMPLEXITY, BY_TYPE, QA_HEAD, QA_QUESTION, QA_TAIL

PLACES = ("{context}", "{question}")


def _choose(key: Column, options: dict[str, str], default: str | None) -> Column:
    out = None
    for name, text in options.items():
        out = F.when(key == name, F.lit(text)) if out is None else out.when(key == name, F.lit(text))
    return out if default is None else out.otherwise(F.lit(default))


def _base_text(language: str, guidelines: bool, cite: bool) -> str:
    base, korean = BASE[language], language != "en"
    parts = [base["system_role"], "", base["task_description"], "", base["context_explanation"], PLACES[0], ""]
    if guidelines:
        parts += ["답변 가이드라인:" if korean else "Answer Guidelines:", *("- " + g for g in base["answer_guidelines"]), ""]
    if cite:
        parts += [base["citation_instruction"], ""]
    parts += [("질문: " if korean else "Question: ") + PLACES[1], "", "답변:" if korean else "Answer:"]
    return "\n".join(parts)


def base_prompt(language: Column, guidelines: bool = True, cite: bool = True) -> Column:
    """Template with {context} and {question}; an unknown language gets the mixed one."""
    return _choose(language, {name: _base_text(name, guidelines, cite) for name in BASE}, _base_text("mixed", guidelines, cite))


def _per_kind(key: Column, table: dict, language: Column, render) -> Column:
    korean = {k: render(v["ko"], True) for k, v in table.items()}
    english = {k: render(v["en"], False) for k, v in table.items()}
    return F.when(language == "ko", _choose(key, korean, None)).otherwise(_choose(key, english, None))


def specific_prompt(language: Column, query_type: Column, complexity: Column, confidence: Column | None = None, include_base: bool = True) -> Column:
    """Base prompt followed by instructions for the question's type and complexity."""

    def by_type(entry, korean):
        instruction, focus, output = entry
        head, areas = ("\n특별 지시사항:", "중점 분석 영역:") if korean else ("\nSpecific Instructions:", "Focus Areas:")
        return "\n".join([head, f"- {instruction}", f"- {areas} {', '.join(focus)}", f"- {output}"])

    def by_level(entry, korean):
        names = ("approach", "detail_level", "structure")
        return "\n".join(["\n답변 형식:" if korean else "\nResponse Format:", *(f"- {n}: {v}" for n, v in zip(names, entry))])

    parts = [base_prompt(language)] if include_base else []
    parts += [_per_kind(query_type, BY_TYPE, language, by_type), _per_kind(complexity, BY_COMPLEXITY, language, by_level)]
    if confidence is not None:
        shown = F.format_string("%.2f", F.round(confidence, 6))
        ko = F.concat(F.lit("\n참고: 이 분석의 신뢰도는 "), shown, F.lit("입니다."))
        en = F.concat(F.lit("\nNote: The confidence score for this analysis is "), shown, F.lit("."))
        parts.append(F.when(language == "ko", ko).otherwise(en))
    return F.concat_ws("\n", *parts)


def chat_prompt(language: Column, query_type: Column, complexity: Column) -> Column:
    """struct(system, human) templates."""
    system = _choose(language, {n: f"{b['system_role']}\n\n{b['task_description']}" for n, b in BASE.items()}, None)
    human = {n: f"{b['context_explanation']}\n{PLACES[0]}\n\n{'Question: ' if n == 'en' else '질문: '}{PLACES[1]}" for n, b in BASE.items()}
    return F.struct(
        F.concat_ws("\n\n", system, specific_prompt(language, query_type, complexity, include_base=False)).alias("system"),
        _choose(language, human, None).alias("human"),
    )


def fill(template: Column, context: Column, question: Column) -> Column:
    return F.replace(F.replace(template, F.lit(PLACES[0]), context), F.lit(PLACES[1]), question)


def qa_prompt(question: Column, context: Column) -> Column:
    """Direct prompt; the context is cut at 3,000 characters, or 1,500 when the prompt is still too long."""
    asked = F.coalesce(F.nullif(strip(question), F.lit("")), F.lit("Unknown query"))
    given = F.coalesce(F.nullif(strip(context), F.lit("")), F.lit("No context available"))
    cut = F.when(F.length(given) > 3000, F.concat(F.substring(given, 1, 3000), F.lit("..."))).otherwise(given)
    build = lambda c: F.concat(F.lit(QA_HEAD), c, F.lit(QA_QUESTION), asked, F.lit(QA_TAIL))
    return F.when(F.length(build(cut)) > 8000, build(F.concat(F.substring(given, 1, 1500), F.lit("...")))).otherwise(build(cut))
