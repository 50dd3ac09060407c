"""Plain versions of the operators for small inputs."""

import re


def lines_of(text: str) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, content) of each line, in bytes."""
    raw = (text or "").encode()
    out, now = [], None
    for m in re.finditer(rb"[^\x09-\x0d\x20]+", raw):
        if now and (b"\n" in raw[now[1] : m.start()] or raw[now[1] - 1 : now[1]] in (b".", b"!", b"?")):
            out.append(now)
            now = None
        now = (now[0] if now else m.start(), m.end(), (now[2] if now else 0) + 1)
    return [(a, b, n, raw[a:b]) for a, b, n in [*out, *([now] if now else [])]]


def repeated_lines(docs: list[tuple[int, str]], words: int) -> dict[int, set[int]]:
    """Lines (by number) that go, per doc_id: those of every run of lines with `words` words or
    more that stands at an earlier place as well."""
    lines = {d: lines_of(t) for d, t in docs}
    first: dict[tuple, tuple[int, int]] = {}
    runs = []
    for d in sorted(lines):
        ls = lines[d]
        for a in range(len(ls)):
            n = 0
            for b in range(a, len(ls)):
                n += ls[b][2]
                if n >= words and (n - ls[a][2] < words or n - ls[b][2] < words):
                    key = tuple(x[3] for x in ls[a : b + 1])
                    runs.append((d, a, b, key))
                    first.setdefault(key, (d, a))
                elif n - ls[a][2] >= words and n - ls[b][2] >= words:
                    break
    out: dict[int, set[int]] = {d: set() for d in lines}
    for d, a, b, key in runs:
        fd, fa = first[key]
        if (fd, fa) != (d, a):
            out[d] |= {i for i in range(a, b + 1) if fd != d or i > fa + b - a}
    return out
