"""A parser for a practical subset of bash, in plain Python for use inside Arrow UDFs.

``parse`` gives a list of statements or None where the text does not parse (an unclosed quote or bracket, a stray closer or
operator). Words keep their quotes and carry the statements of the command substitutions in them.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass
class Word:
    text: str
    kind: str  # word, string, raw or mixed
    subs: list[list] = field(default_factory=list)


@dataclass
class Command:
    words: list[Word]
    redirects: list[tuple[str, Word]] = field(default_factory=list)

    @property
    def name(self) -> str:
        return self.words[0].text.rsplit("/", 1)[-1] if self.words else ""

    @property
    def args(self) -> list[Word]:
        return self.words[1:]


@dataclass
class Pipeline:
    parts: list


@dataclass
class Group:
    body: list
    redirects: list[tuple[str, Word]] = field(default_factory=list)


@dataclass
class Function:
    name: str
    body: list
    braces: bool


class Bad(Exception):
    pass


SKIPPED = {"if", "then", "else", "elif", "while", "until", "do", "!", "time"}
CLOSERS = {"fi": "if", "done": "do", "esac": "case"}
META = set(" \t\n;&|<>()")
DEPTH = 40


class _Parser:
    def __init__(self, src: str, depth: int = 0):
        if depth > DEPTH:
            raise Bad
        self.s, self.i, self.depth = src, 0, depth
        self.open: list[str] = []
        self.docs: list[str] = []

    def peek(self, n: int = 1) -> str:
        return self.s[self.i : self.i + n]

    def blanks(self) -> None:
        while self.i < len(self.s):
            if self.s[self.i] in " \t":
                self.i += 1
            elif self.peek(2) == "\\\n":
                self.i += 2
            elif self.s[self.i] == "#" and (self.i == 0 or self.s[self.i - 1] in " \t\n;&|("):
                while self.i < len(self.s) and self.s[self.i] != "\n":
                    self.i += 1
            else:
                break

    def newline(self) -> None:
        self.i += 1
        for end in self.docs:
            while self.i < len(self.s):
                stop = self.s.find("\n", self.i)
                stop = len(self.s) if stop < 0 else stop
                line, self.i = self.s[self.i : stop], stop + 1
                if line.lstrip("\t") == end:
                    break
        self.i = min(self.i, len(self.s))
        self.docs = []

    def statements(self, until: str = "") -> list:
        out = []
        while True:
            self.blanks()
            if self.i >= len(self.s):
                if until or self.open:
                    raise Bad
                return out
            c = self.s[self.i]
            if c == "\n":
                self.newline()
            elif c == ";" and self.peek(2) in (";;", ";&"):
                if "case" not in self.open:
                    raise Bad
                self.i += 2
                self.pattern()
            elif c in ";&" and out and self.peek(2) != "&&":
                self.i += 1
            elif until and c == until:
                self.i += 1
                return out
            elif c in ")}" and c != until and c == ")":
                raise Bad
            else:
                x = self.pipeline(until)
                if x is not None:
                    out.append(x)
                self.blanks()
                if self.peek(2) in ("&&", "||"):
                    self.i += 2
                    self.skip_lines()
                    if self.i >= len(self.s):
                        raise Bad

    def skip_lines(self) -> None:
        self.blanks()
        while self.peek() == "\n":
            self.newline()
            self.blanks()

    def pipeline(self, until: str):
        parts = [self.command(until)]
        while True:
            self.blanks()
            if self.peek() == "|" and self.peek(2) != "||":
                self.i += 2 if self.peek(2) == "|&" else 1
                self.skip_lines()
                if self.i >= len(self.s) or self.peek() in ";|&":
                    raise Bad
                parts.append(self.command(until))
            else:
                break
        parts = [p for p in parts if p is not None]
        return (parts[0] if parts else None) if len(parts) < 2 else Pipeline(parts)

    def command(self, until: str):
        self.blanks()
        if self.peek(2) == "((":
            self.balanced("((", "))")
            return None
        if self.peek() == "(":
            self.i += 1
            return self.with_redirects(Group(self.sub(")")))
        if self.peek(2) == "[[":
            end = self.s.find("]]", self.i)
            if end < 0:
                raise Bad
            self.i = end + 2
            return None
        words: list[Word] = []
        redirects: list[tuple[str, Word]] = []
        while True:
            self.blanks()
            if self.i >= len(self.s) or self.s[self.i] in "\n;|)" or (self.s[self.i] == "&" and self.peek(2) != "&>"):
                break
            r = self.redirect()
            if r:
                redirects.append(r)
                continue
            if self.peek() == "(":
                if len(words) == 1 and self.s[self.i :].lstrip("( \t").startswith(")"):
                    self.i = self.s.index(")", self.i) + 1
                    return self.function(words[0].text)
                raise Bad
            w = self.word()
            if not words and not redirects:
                if w.text in SKIPPED:
                    if w.text in ("if", "do"):
                        self.open.append(w.text)
                    if w.text in ("then", "elif", "else") and "if" not in self.open:
                        raise Bad
                    self.blanks()
                    continue
                if w.text in CLOSERS:
                    if not self.open or self.open[-1] != CLOSERS[w.text]:
                        raise Bad
                    self.open.pop()
                    return self.with_redirects(Group([])) and None
                if w.text in ("for", "select"):
                    while self.i < len(self.s) and self.s[self.i] not in ";\n":
                        if self.peek(2) == "((":
                            self.balanced("((", "))")
                        else:
                            self.blanks()
                            if self.i < len(self.s) and self.s[self.i] not in ";\n":
                                words.append(self.word())
                    return Command([Word(":", "word"), *words]) if any(x.subs for x in words) else None
                if w.text == "case":
                    words.append(self.word_after())
                    self.skip_lines()
                    if self.word().text != "in":
                        raise Bad
                    self.open.append("case")
                    self.pattern()
                    return Command([Word(":", "word"), *words]) if any(x.subs for x in words) else None
                if w.text == "function":
                    name = self.word_after().text
                    self.blanks()
                    if self.peek(2) == "()":
                        self.i += 2
                    return self.function(name)
                if w.text == "{":
                    return self.with_redirects(Group(self.sub("}")))
                if w.text == "}":
                    raise Bad
            words.append(w)
        # assignments before a command are no command names
        while words and words[0].kind != "string" and _assignment(words[0].text) and len(words) > 1:
            redirects += [("=", words.pop(0))]
        if words and _assignment(words[0].text):
            return Command([Word("", "word"), words[0]], redirects)
        return Command(words, redirects) if words or redirects else None

    def word_after(self) -> Word:
        self.blanks()
        if self.i >= len(self.s):
            raise Bad
        return self.word()

    def pattern(self) -> None:
        """Skip a case pattern up to its bracket, or stand before esac."""
        self.skip_lines()
        if self.s.startswith("esac", self.i):
            return
        end = self.s.find(")", self.i)
        if end < 0:
            raise Bad
        self.i = end + 1

    def function(self, name: str):
        self.skip_lines()
        braces = self.peek() == "{"
        if self.peek() not in ("{", "("):
            raise Bad
        close = "}" if braces else ")"
        self.i += 1
        f = Function(name, self.sub(close), braces)
        self.with_redirects(Group([]))
        return f

    def sub(self, close: str) -> list:
        inner, self.open = self.open, []
        self.depth += 1
        if self.depth > DEPTH:
            raise Bad
        out = self.statements(close)
        if self.open:
            raise Bad
        self.open = inner
        self.depth -= 1
        return out

    def with_redirects(self, g: Group) -> Group:
        while True:
            self.blanks()
            r = self.redirect()
            if not r:
                return g
            g.redirects.append(r)

    def redirect(self):
        j = self.i
        while j < len(self.s) and self.s[j].isdigit():
            j += 1
        for op in ("&>>", "<<<", "<<-", "&>", ">>", ">&", "<&", "<>", ">|", "<<", ">", "<"):
            if self.s.startswith(op, j if op[0] != "&" else self.i):
                if op in ("<", ">") and self.s.startswith("(", j + 1):
                    return None
                self.i = (j if op[0] != "&" else self.i) + len(op)
                self.blanks()
                if self.i >= len(self.s) or self.s[self.i] in "\n;|":
                    raise Bad
                w = self.word()
                if op in ("<<", "<<-"):
                    self.docs.append(w.text.strip("'\"\\"))
                return op, w
        return None

    def balanced(self, a: str, b: str) -> None:
        end = self.s.find(b, self.i + len(a))
        if end < 0:
            raise Bad
        self.i = end + len(b)

    def substitution(self, subs: list) -> None:
        """At ``$(`` , ``<(`` or ``>(``."""
        if self.peek(3) == "$((":
            self.balanced("$((", "))")
            return
        self.i += 2
        subs.append(self.sub(")"))

    def dollar(self, subs: list) -> None:
        if self.peek(2) == "$(":
            self.substitution(subs)
        elif self.peek(2) == "${":
            level = 0
            while self.i < len(self.s):
                if self.peek(2) == "${":
                    level += 1
                    self.i += 2
                elif self.peek(2) == "$(":
                    self.substitution(subs)
                elif self.s[self.i] == "}":
                    level -= 1
                    self.i += 1
                    if not level:
                        return
                else:
                    self.i += 1
            raise Bad
        else:
            self.i += 1

    def backtick(self, subs: list) -> None:
        end = self.s.find("`", self.i + 1)
        while end > 0 and self.s[end - 1] == "\\":
            end = self.s.find("`", end + 1)
        if end < 0:
            raise Bad
        subs.append(_Parser(self.s[self.i + 1 : end], self.depth + 1).statements())
        self.i = end + 1

    def word(self) -> Word:
        start, kinds, subs = self.i, [], []
        while self.i < len(self.s):
            c = self.s[self.i]
            if c in "<>" and self.peek(2) in ("<(", ">("):
                self.substitution(subs)
                kinds.append("word")
            elif c in META:
                break
            elif c == "\\":
                self.i += 2
                kinds.append("word")
            elif c == "'" or self.peek(2) == "$'":
                self.i += 1 if c == "'" else 2
                escape = c == "$"
                while self.i < len(self.s) and self.s[self.i] != "'":
                    self.i += 2 if escape and self.s[self.i] == "\\" else 1
                if self.i >= len(self.s):
                    raise Bad
                self.i += 1
                kinds.append("raw")
            elif c == '"' or self.peek(2) == '$"':
                self.i += 1 if c == '"' else 2
                while self.i < len(self.s) and self.s[self.i] != '"':
                    if self.s[self.i] == "\\":
                        self.i += 2
                    elif self.s[self.i] == "$":
                        self.dollar(subs)
                    elif self.s[self.i] == "`":
                        self.backtick(subs)
                    else:
                        self.i += 1
                if self.i >= len(self.s):
                    raise Bad
                self.i += 1
                kinds.append("string")
            elif c == "`":
                self.backtick(subs)
                kinds.append("sub")
            elif c == "$":
                at = self.i
                self.dollar(subs)
                kinds.append("sub" if self.i > at + 1 else "word")
                while self.i < len(self.s) and kinds[-1] == "word" and (self.s[self.i].isalnum() or self.s[self.i] == "_"):
                    self.i += 1
                kinds[-1] = "sub"
            else:
                self.i += 1
                if not kinds or kinds[-1] != "word":
                    kinds.append("word")
        self.i = min(self.i, len(self.s))
        if self.i == start:
            raise Bad
        kind = kinds[0] if len(set(kinds)) == 1 and len(kinds) == 1 else ("word" if set(kinds) == {"word"} else "mixed")
        return Word(self.s[start : self.i], kind, subs)


def _assignment(t: str) -> bool:
    name, eq, _ = t.partition("=")
    name = name.removesuffix("+").partition("[")[0]
    return bool(eq) and name.isidentifier() and name.isascii()


def parse(src: str, depth: int = 0) -> list | None:
    try:
        return _Parser(src, depth).statements()
    except (Bad, RecursionError):
        return None
