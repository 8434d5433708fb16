"""The example and score rules once more, in plain Python and independent of Spark."""

import regex

SPACE = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0"
PIECE = regex.compile(r"</?think>|</?answer>|[\p{L}\p{N}]+|.", regex.DOTALL)


def spans(text):
    return [
        (m.group(), m.start(), m.end()) for m in PIECE.finditer(text) if not m.group().isspace()
    ]


def box_place(solution):
    """First and last place of what stands in the first box that is closed; -1 without one."""
    mark = "\\boxed{"
    low = solution.find(mark)
    if low < 0:
        return -1, -1
    low += len(mark)
    high = solution.find("}", low)
    return (low, high) if high >= 0 else (-1, -1)


def example(problem, solution, length, system_prompt=None):
    head = f"{system_prompt}\n" if system_prompt else ""
    prompt = f"{head}Question: {problem or ''}\n"
    solution = solution or ""
    tokens = spans(prompt + solution)[:length]
    start = len(spans(prompt))
    words = [t for t, _, _ in tokens]
    target = range(start, len(words))
    opens = [i for i in target if words[i] == "<think>"]
    closes = [i for i in target if words[i] == "</think>"]
    status, inside = "ok", []
    if opens:
        after = [i for i in closes if i > opens[0]]
        if after:
            inside = list(range(opens[0] + 1, after[0]))
        else:
            status = "think_unclosed"
    elif closes:
        status = "think_orphan_end"
    low, high = box_place(solution)
    answer = []
    if low >= 0:
        low, high = low + len(prompt), high + len(prompt)
        answer = [i for i in target if tokens[i][1] >= low and tokens[i][2] <= high]
        if status == "ok" and not answer:
            status = "answer_unmapped"
    else:
        status = "no_boxed"
    return {
        "tokens": words,
        "start": start,
        "n_tgt": len(target),
        "think": inside,
        "answer": answer,
        "status": status,
    }


def repetition(words, n=4, coeff=1.0):
    if len(words) <= n:
        return None
    grams = [tuple(words[k : k + n]) for k in range(len(words) - n + 1)]
    return coeff * (len(grams) - len(set(grams))) / len(grams)
