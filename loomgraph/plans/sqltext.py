"""SQL texts: tokens, shapes without values, and trees of queries and statements.

The dialect is the one a warehouse log is written in: backticked paths, UNNEST, QUALIFY, MERGE, arrays and structs.
Spark's own parser reads another dialect and stops at several of these, so texts are read here, in plain Python that a
task applies to its rows.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<skip>\s+|--[^\n]*|\#[^\n]*|/\*.*?\*/)
    |(?P<path>`[^`]*`)
    |(?P<str>[rRbB]?(?:'''.*?'''|\"\"\".*?\"\"\"|'(?:[^'\\]|\\.|'')*'|"(?:[^"\\]|\\.)*"))
    |(?P<num>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)
    |(?P<id>[A-Za-z_][A-Za-z_0-9]*)
    |(?P<param>@{1,2}[A-Za-z_][A-Za-z_0-9]*|\?)
    |(?P<op><=>|<>|!=|<=|>=|\|\||<<|>>|=>|->|[-+*/%=<>(),.;:\[\]&|^~{}$])""",
    re.X | re.S,
)
#: Words that end an alias-free expression or source, so that they can't be read as an alias.
RESERVED = set(
    "ALL AND AS ASC BETWEEN BY CASE CROSS CURRENT DESC DISTINCT ELSE END EXCEPT EXISTS FALSE FOR FROM FULL GROUP HAVING IN INNER INTERSECT INTERVAL INTO IS JOIN LEFT LIKE LIMIT NATURAL NOT NULL OFFSET ON OR ORDER OUTER OVER PARTITION QUALIFY RIGHT ROWS RANGE SELECT SET TABLESAMPLE THEN TRUE UNION UNNEST USING VALUES WHEN WHERE WINDOW WITH MATCHED".split()
)
COMPARISONS = {"=": "=", "<": "<", "<=": "<=", ">": ">", ">=": ">=", "!=": "!=", "<>": "!="}
#: Functions that fold rows.
AGGREGATES = set("ANY_VALUE APPROX_COUNT_DISTINCT APPROX_QUANTILES APPROX_TOP_COUNT ARRAY_AGG ARRAY_CONCAT_AGG AVG CORR COUNT COUNTIF COVAR_POP COVAR_SAMP LOGICAL_AND LOGICAL_OR MAX MAX_BY MIN MIN_BY STDDEV STDDEV_POP STDDEV_SAMP STRING_AGG SUM VARIANCE VAR_POP VAR_SAMP".split())
DATE_WORDS = {"DATE", "TIMESTAMP", "DATETIME", "TIME", "NUMERIC", "BIGNUMERIC", "JSON"}


class SqlError(ValueError):
    """The text can't be read."""


@dataclass
class Token:
    kind: str
    text: str
    at: int
    slot: int | None = None

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "id" else ""


def tokens(sql: str) -> list[Token]:
    """Tokens without comments and blanks; each literal has its slot. A minus sign belongs to the number it negates."""
    out, at = [], 0
    while at < len(sql):
        m = TOKEN.match(sql, at)
        if not m:
            raise SqlError(f"unreadable at {at}: {sql[at : at + 20]!r}")
        if m.lastgroup != "skip":
            kind, text = m.lastgroup, m.group()
            if kind == "num" and out and out[-1].text == "-" and (len(out) < 2 or (out[-2].kind == "op" and out[-2].text not in (")", "]")) or out[-2].word in RESERVED):
                out.pop()
                text = "-" + text
            out.append(Token(kind, text, m.start()))
        at = m.end()
    return slotted(out)


def slotted(found: list[Token]) -> list[Token]:
    """Number the literals; an array of literals alone is one slot."""
    slot, i = 0, 0
    while i < len(found):
        t = found[i]
        if t.text == "[" and (end := literal_array(found, i)):
            for x in found[i:end]:
                x.slot = slot if x.kind in ("str", "num") else None
            slot, i = slot + 1, end
            continue
        if t.kind in ("str", "num"):
            t.slot, slot = slot, slot + 1
        i += 1
    return found


def literal_array(found: list[Token], i: int) -> int | None:
    """The place after the array of literals that starts at i, if one does; a subscript is none."""
    if i and (found[i - 1].kind in ("path", "str") or found[i - 1].text in (")", "]") or (found[i - 1].kind == "id" and found[i - 1].word not in RESERVED)):
        return None
    j = i + 1
    while j + 1 < len(found) and found[j].kind in ("str", "num"):
        if found[j + 1].text == "]":
            return j + 2
        if found[j + 1].text != ",":
            return None
        j += 2
    return None


def value(t: Token) -> str:
    """What a literal token says."""
    if t.kind == "num":
        return t.text
    body = t.text.lstrip("rRbB")
    cut = 3 if body[:3] in ("'''", '"""') else 1
    return re.sub(r"\\(.)", r"\1", body[cut:-cut])


@dataclass
class Names:
    """How names as written become names of tables: aliases of projects and datasets, rules, families of date shards."""

    aliases: dict[str, str] = field(default_factory=dict)
    rules: list[tuple[str, str]] = field(default_factory=list)
    families: set[str] = field(default_factory=set)
    project: str | None = None

    def canonical(self, path: str) -> str:
        parts = path.replace("`", "").split(".")
        if len(parts) == 2 and self.project:
            parts = [self.project, *parts]
        if len(parts) >= 3 and (to := self.aliases.get(".".join(parts[:2]))):
            parts = [*to.split("."), *parts[2:]]
        name = parts[-1]
        for pattern, to in self.rules:
            name = re.sub(pattern, lambda m, to=to: to, name)
        if m := re.fullmatch(r"(.*?)(\d{8}|\d{6})", name):
            if ".".join([*parts[:-1], m[1]]) in self.families:
                name = m[1] + "*"
        return ".".join([*parts[:-1], name])


def transient(name: str) -> bool:
    """Whether a rule took what changes from run to run out of the name."""
    return "{" in name


def is_system(name: str) -> bool:
    return "INFORMATION_SCHEMA" in name.upper()


TABLE_WORDS = {"FROM", "JOIN", "INTO", "UPDATE", "TABLE", "VIEW", "USING", "MERGE"}
CLAUSES = {"SELECT", "WHERE", "GROUP", "ORDER", "HAVING", "QUALIFY", "LIMIT", "SET", "VALUES"}


def shape_sql(sql: str, names: Names | None = None) -> tuple[str, list[list[str]], int]:
    """(text, literals, statements): the text with literals as ?, one blank between tokens, and names as tables have them.

    Words are upper case where they are reserved and lower case elsewhere, tables as their canonical name.
    """
    names, found, out, literals, i = names or Names(), tokens(sql), [], [], 0
    many = sum(1 for a, b in itertools.pairwise([*found, Token("op", ";", 0)]) if b.text == ";" and a.text != ";")
    while found and found[-1].text == ";":
        found.pop()
    expects, listing = False, [False]  # whether a table comes next, and whether commas here stand between tables
    while i < len(found):
        t = found[i]
        if t.slot is not None or (t.text == "[" and i + 1 < len(found) and found[i + 1].slot is not None and literal_array(found, i)):
            array = t.text == "["
            end = literal_array(found, i) if array else i + 1
            literals.append([value(x) for x in found[i:end] if x.kind in ("str", "num")])
            out.append("?")
            i = end
            continue
        if t.kind == "path" or (expects and t.kind == "id" and t.word not in RESERVED):
            j = i + 1
            while j + 1 < len(found) and found[j].text == "." and found[j + 1].kind in ("path", "id"):
                j += 2
            whole = ".".join(x.text.strip("`") for x in found[i:j:2])
            out.append(names.canonical(whole) if "." in whole else whole if expects else whole.lower())
            i, expects = j, False
            continue
        if t.text in "()":
            listing = [*listing, False] if t.text == "(" else listing[:-1] or [False]
        elif t.word in TABLE_WORDS or t.word in CLAUSES:
            listing[-1] = t.word == "FROM" or (t.word == "JOIN" and listing[-1])
        part = t.word == "FROM" and out[-2:-1] == ["("] and out[-3:-2] == ["extract"]
        expects = (t.word in TABLE_WORDS and not part) or (t.text == "," and listing[-1]) or (expects and t.word in ("OR", "REPLACE", "IF", "NOT", "EXISTS"))
        out.append(t.word if t.word in RESERVED else t.text.lower() if t.kind == "id" else t.text)
        i += 1
    return " ".join(out), literals, many


def fingerprint(sql: str, names: Names | None = None) -> dict:
    """{shape_id, literals, statements, error}: texts that differ in literals, comments, blanks or case have one shape."""
    try:
        text, literals, many = shape_sql(sql, names)
    except SqlError as e:
        return {"shape_id": None, "literals": [], "statements": 0, "error": str(e)}
    return {"shape_id": hashlib.sha256(text.encode()).hexdigest(), "literals": literals, "statements": many, "error": None}


@dataclass
class Node:
    """A piece of a tree: kind says which, the other fields are what that kind has."""

    kind: str
    name: str = ""
    args: list = field(default_factory=list)
    more: dict = field(default_factory=dict)

    def __getitem__(self, key: str):
        return self.more.get(key)


class Parser:
    def __init__(self, sql: str):
        self.found, self.i = tokens(sql), 0

    # -- tokens
    def peek(self, k: int = 0) -> Token:
        return self.found[self.i + k] if self.i + k < len(self.found) else Token("end", "", -1)

    def at(self, *words: str) -> bool:
        return all(self.peek(k).word == w or self.peek(k).text == w for k, w in enumerate(words))

    def take(self, *words: str) -> bool:
        if self.at(*words):
            self.i += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"expected {' '.join(words)} at {self.peek().at}, found {self.peek().text!r}")

    def next(self) -> Token:
        t = self.peek()
        if t.kind == "end":
            raise SqlError("the text ends early")
        self.i += 1
        return t

    def word(self) -> str:
        t = self.next()
        if t.kind not in ("id", "path"):
            raise SqlError(f"expected a name at {t.at}, found {t.text!r}")
        return t.text.strip("`")

    def listed(self, one, end: str | None = None) -> list:
        out = []
        while not (end and self.at(end)):
            out.append(one())
            if not self.take(","):
                break
        return out

    def skip_parens(self) -> None:
        depth = 0
        while True:
            t = self.next()
            depth += (t.text == "(") - (t.text == ")")
            if not depth:
                return

    # -- statements
    def statements(self) -> list[Node]:
        out = []
        while self.peek().kind != "end":
            if not self.take(";"):
                out.append(self.statement())
                if self.peek().kind != "end":
                    self.need(";")
        return out

    def statement(self) -> Node:
        if self.at("CREATE"):
            return self.create()
        if self.take("INSERT"):
            self.take("INTO")
            path, columns = self.path(), self.columns()
            if self.take("VALUES"):
                return Node("insert", path, [], {"columns": columns, "rows": self.listed(self.tuple_)})
            return Node("insert", path, [self.query()], {"columns": columns})
        if self.take("UPDATE"):
            target = self.source()
            self.need("SET")
            sets = self.listed(self.assignment)
            other = self.from_() if self.take("FROM") else None
            return Node("update", target.name, [], {"target": target, "sets": sets, "from": other, "where": self.expr() if self.take("WHERE") else None})
        if self.take("DELETE"):
            self.take("FROM")
            target = self.source()
            return Node("delete", target.name, [], {"target": target, "where": self.expr() if self.take("WHERE") else None})
        if self.take("MERGE"):
            return self.merge()
        if self.at("SELECT") or self.at("WITH") or self.at("("):
            return self.query()
        first = self.peek().word or self.peek().text
        if not first.isalpha() or first.startswith("SELE"):
            raise SqlError(f"no statement starts with {self.peek().text!r}")
        while self.peek().kind != "end" and not self.at(";"):
            self.i += 1
        return Node("other", first)

    def create(self) -> Node:
        self.need("CREATE")
        if self.take("OR"):
            self.need("REPLACE")
        for w in ("TEMP", "TEMPORARY", "MATERIALIZED", "EXTERNAL"):
            self.take(w)
        kind = self.next().word
        if kind not in ("TABLE", "VIEW"):
            while self.peek().kind != "end" and not self.at(";"):
                self.i += 1
            return Node("other", f"CREATE_{kind}")
        if self.take("IF"):
            self.need("NOT", "EXISTS")
        path = self.path()
        while self.peek().kind != "end" and not self.at("AS") and not self.at(";"):
            if self.at("("):
                self.skip_parens()
            else:
                self.i += 1
        query = self.query() if self.take("AS") else None
        return Node("create_" + kind.lower(), path, [query] if query else [])

    def merge(self) -> Node:
        self.take("INTO")
        target = self.source()
        self.need("USING")
        source = self.source()
        self.need("ON")
        on, clauses = self.expr(), []
        while self.take("WHEN"):
            matched = not self.take("NOT")
            self.need("MATCHED")
            by = self.next().word if self.take("BY") else None
            cond = self.expr() if self.take("AND") else None
            self.need("THEN")
            if self.take("DELETE"):
                clauses.append(Node("delete", "", [], {"when": cond}))
            elif self.take("UPDATE"):
                self.need("SET")
                clauses.append(Node("update", "", self.listed(self.assignment), {"when": cond}))
            else:
                self.need("INSERT")
                if self.take("ROW"):
                    clauses.append(Node("insert_row", "", [], {"when": cond}))
                else:
                    columns = self.columns()
                    if self.take("ROW"):
                        clauses.append(Node("insert_row", "", [], {"when": cond}))
                    else:
                        self.need("VALUES")
                        clauses.append(Node("insert", "", self.tuple_().args, {"columns": columns, "when": cond}))
            clauses[-1].more |= {"matched": matched, "by": by}
        return Node("merge", target.name, [], {"target": target, "source": source, "on": on, "clauses": clauses})

    def assignment(self) -> tuple[str, Node]:
        name = self.word()
        while self.take("."):
            name = self.word()
        self.need("=")
        return name, self.expr()

    def columns(self) -> list[str] | None:
        if not self.at("(") or self.peek(1).word in ("SELECT", "WITH"):
            return None
        self.need("(")
        out = self.listed(self.word, ")")
        self.need(")")
        return out

    def tuple_(self) -> Node:
        self.need("(")
        out = self.listed(self.expr, ")")
        self.need(")")
        return Node("tuple", "", out)

    def path(self) -> str:
        out = [self.word()]
        while True:
            if self.at(".") and self.peek(1).kind in ("id", "path"):
                self.i += 1
                out.append(self.word())
            elif self.at("-") and self.peek(1).kind == "id" and self.peek(1).at == self.peek().at + 1 and len(out) == 1:
                self.i += 1
                out[-1] += "-" + self.word()
            else:
                return ".".join(out)

    # -- queries
    def query(self) -> Node:
        ctes = []
        if self.take("WITH"):
            self.take("RECURSIVE")
            ctes = self.listed(self.cte)
        body = self.set_operation()
        order = self.ordering() if self.take("ORDER", "BY") else []
        limit = self.expr() if self.take("LIMIT") else None
        if self.take("OFFSET"):
            self.expr()
        return Node("query", "", [body], {"ctes": ctes, "order": order, "limit": limit})

    def cte(self) -> tuple[str, Node]:
        name = self.word()
        self.need("AS")
        self.need("(")
        q = self.query()
        self.need(")")
        return name, q

    def set_operation(self) -> Node:
        left = self.term()
        while self.peek().word in ("UNION", "INTERSECT", "EXCEPT"):
            op = self.next().word
            how = self.next().word if self.peek().word in ("ALL", "DISTINCT") else ""
            left = Node("set", f"{op} {how}".strip(), [left, self.term()])
        return left

    def term(self) -> Node:
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        return self.select()

    def select(self) -> Node:
        self.need("SELECT")
        distinct = self.take("DISTINCT")
        self.take("ALL")
        if self.take("AS"):
            self.next()
        s = Node("select", "", self.listed(self.item, "FROM"), {"distinct": distinct, "group": [], "windows": {}})
        if self.take("FROM"):
            s.more["from"] = self.from_()
        if self.take("WHERE"):
            s.more["where"] = self.expr()
        if self.take("GROUP", "BY"):
            s.more["group"] = "ALL" if self.take("ALL") else self.listed(self.expr)
        if self.take("HAVING"):
            s.more["having"] = self.expr()
        if self.take("QUALIFY"):
            s.more["qualify"] = self.expr()
        if self.take("WINDOW"):
            s.more["windows"] = dict(self.listed(lambda: (self.word(), self.take("AS") and self.window())))
        return s

    def item(self) -> tuple[Node, str | None]:
        if self.take("*"):
            return Node("star", "", [], self.star_rest()), None
        if self.peek().kind in ("id", "path") and self.peek(1).text == "." and self.peek(2).text == "*":
            name = self.word()
            self.i += 2
            return Node("star", name, [], self.star_rest()), None
        return self.expr(), self.alias()

    def star_rest(self) -> dict:
        rest: dict = {"except": [], "replace": {}}
        if self.take("EXCEPT"):
            self.need("(")
            rest["except"] = [x.lower() for x in self.listed(self.word)]
            self.need(")")
        if self.take("REPLACE"):
            self.need("(")
            rest["replace"] = {a.lower(): e for e, a in self.listed(lambda: (self.expr(), self.alias()))}
            self.need(")")
        return rest

    def alias(self) -> str | None:
        if self.take("AS"):
            return self.word()
        if self.peek().kind == "path" or (self.peek().kind == "id" and self.peek().word not in RESERVED):
            return self.word()
        return None

    def from_(self) -> Node:
        left = self.source()
        while True:
            if self.take(","):
                left = Node("join", "COMMA", [left, self.source()])
                continue
            kind = "INNER"
            start = self.i
            self.take("NATURAL")
            for w in ("INNER", "LEFT", "RIGHT", "FULL", "CROSS"):
                if self.take(w):
                    kind = w
            self.take("OUTER")
            if not self.take("JOIN"):
                self.i = start
                return left
            right = self.source()
            j = Node("join", kind, [left, right])
            if self.take("ON"):
                j.more["on"] = self.expr()
            elif self.take("USING"):
                j.more["using"] = self.columns()
            left = j

    def source(self) -> Node:
        if self.take("UNNEST"):
            self.need("(")
            e = self.expr()
            self.need(")")
            alias = self.alias()
            offset = None
            if self.take("WITH", "OFFSET"):
                offset = self.alias() or "offset"
            return Node("unnest", "", [e], {"alias": alias, "offset": offset})
        if self.take("("):
            if self.at("SELECT") or self.at("WITH") or self.at("("):
                q = self.query()
                self.need(")")
                return Node("sub", "", [q], {"alias": self.alias()})
            inner = self.from_()
            self.need(")")
            return inner
        path = self.path()
        if self.at("("):
            self.skip_parens()
        alias = self.alias()
        if self.take("TABLESAMPLE"):
            self.next()
            self.skip_parens()
        if self.take("FOR"):
            while not self.take("OF"):
                self.i += 1
            self.expr()
        return Node("table", path, [], {"alias": alias or (self.alias() if self.peek().kind == "id" else None)})

    def ordering(self) -> list[Node]:
        def one() -> Node:
            e = self.expr()
            self.take("ASC") or self.take("DESC")
            if self.take("NULLS"):
                self.next()
            return e

        return self.listed(one)

    # -- expressions, loosest first
    def expr(self) -> Node:
        left = self.conjunction()
        while self.take("OR"):
            left = Node("or", "", [left, self.conjunction()])
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.take("AND"):
            left = Node("and", "", [left, self.negation()])
        return left

    def negation(self) -> Node:
        if self.take("NOT"):
            return Node("not", "", [self.negation()])
        return self.comparison()

    def comparison(self) -> Node:
        left = self.bits()
        while True:
            start, no = self.i, self.take("NOT")
            if self.take("IN"):
                if self.take("UNNEST"):
                    right: list | Node = [self.tuple_()]
                else:
                    self.need("(")
                    right = self.query() if self.at("SELECT") or self.at("WITH") else self.listed(self.expr, ")")
                    self.need(")")
                left = Node("in", "", [left], {"of": right, "not": no})
            elif self.take("BETWEEN"):
                low = self.bits()
                self.need("AND")
                left = Node("between", "", [left, low, self.bits()], {"not": no})
            elif self.take("LIKE"):
                left = Node("like", "LIKE", [left, self.bits()], {"not": no})
            elif no:
                self.i = start
                return left
            elif self.take("IS"):
                no = self.take("NOT")
                if self.take("DISTINCT", "FROM"):
                    left = Node("compare", "=" if no else "!=", [left, self.bits()])
                else:
                    left = Node("is", self.next().word, [left], {"not": no})
            elif self.peek().text in COMPARISONS and self.peek().kind == "op":
                left = Node("compare", COMPARISONS[self.next().text], [left, self.bits()])
            else:
                return left

    def bits(self) -> Node:
        left = self.sums()
        while self.peek().text in ("|", "&", "^", "<<", ">>") and self.peek().kind == "op":
            left = Node("binary", self.next().text, [left, self.sums()])
        return left

    def sums(self) -> Node:
        left = self.products()
        while True:
            if self.peek().text in ("+", "-", "||") and self.peek().kind == "op":
                left = Node("binary", self.next().text, [left, self.products()])
            elif self.peek().kind == "num" and self.peek().text.startswith("-") and self.found[self.i - 1].kind != "op":
                left = Node("binary", "+", [left, self.products()])
            else:
                return left

    def products(self) -> Node:
        left = self.unary()
        while self.peek().text in ("*", "/", "%") and self.peek().kind == "op":
            left = Node("binary", self.next().text, [left, self.unary()])
        return left

    def unary(self) -> Node:
        if self.peek().kind == "op" and self.peek().text in ("-", "+", "~"):
            return Node("unary", self.next().text, [self.unary()])
        e = self.primary()
        while True:
            if self.take("["):
                i = self.expr()
                self.need("]")
                e = Node("index", "", [e, i])
            elif self.at(".") and self.peek(1).kind in ("id", "path"):
                self.i += 1
                e = Node("field", self.word(), [e])
            else:
                return e

    def primary(self) -> Node:
        t = self.peek()
        if t.kind in ("str", "num"):
            self.i += 1
            return Node("literal", value(t), [], {"slot": t.slot, "text": t.kind == "str"})
        if t.kind == "param":
            self.i += 1
            return Node("param", t.text)
        if self.take("("):
            if self.at("SELECT") or self.at("WITH"):
                q = self.query()
                self.need(")")
                return Node("subquery", "", [q])
            found = self.listed(self.expr, ")")
            self.need(")")
            return found[0] if len(found) == 1 else Node("tuple", "", found)
        if self.take("["):
            found = self.listed(self.expr, "]")
            self.need("]")
            return Node("array", "", found)
        w = t.word
        if w in ("TRUE", "FALSE", "NULL"):
            self.i += 1
            return Node("constant", w)
        if w == "CASE":
            return self.case()
        if w == "EXISTS" and self.peek(1).text == "(":
            self.i += 2
            q = self.query()
            self.need(")")
            return Node("exists", "", [q])
        if w == "INTERVAL":
            self.i += 1
            e = self.unary()
            return Node("interval", self.next().word, [e])
        if w in DATE_WORDS and self.peek(1).kind == "str":
            self.i += 1
            lit = self.primary()
            return Node("literal", lit.name, [], lit.more | {"type": w})
        if w in ("ARRAY", "STRUCT") and self.peek(1).text in ("<", "["):
            self.i += 1
            self.skip_type()
            return self.primary()
        if w in RESERVED and w not in ("LEFT", "RIGHT", "IN", "SET", "OFFSET", "CURRENT", "RANGE", "FOR"):
            raise SqlError(f"unexpected {t.text!r} at {t.at}")
        if t.kind not in ("id", "path"):
            raise SqlError(f"unexpected {t.text!r} at {t.at}")
        if t.kind == "id" and self.peek(1).text == "(":
            return self.call()
        parts = self.word().split(".") if t.kind == "path" else [self.word()]
        while self.at(".") and self.peek(1).kind in ("id", "path") and self.peek(2).text != "(":
            self.i += 1
            parts.append(self.word())
        if self.at(".") and self.peek(2).text == "(":  # a function in a namespace
            self.i += 1
            return self.call()
        return Node("column", "", parts)

    def skip_type(self) -> None:
        depth = 0
        while self.at("<") or depth:
            x = self.next().text
            depth += {"<": 1, ">": -1, ">>": -2}.get(x, 0)

    def case(self) -> Node:
        self.need("CASE")
        operand = None if self.at("WHEN") else self.expr()
        whens = []
        while self.take("WHEN"):
            c = self.expr()
            self.need("THEN")
            whens.append((c, self.expr()))
        other = self.expr() if self.take("ELSE") else None
        self.need("END")
        return Node("case", "", [], {"operand": operand, "whens": whens, "else": other})

    def type_(self) -> str:
        out = self.next().text
        if self.at("<"):
            start = self.i
            self.skip_type()
            out += "".join(x.text for x in self.found[start : self.i])
        elif self.at("("):
            self.skip_parens()
        return out.upper()

    def call(self) -> Node:
        name = self.next().word
        self.need("(")
        more: dict = {}
        if name in ("CAST", "SAFE_CAST"):
            e = self.expr()
            self.need("AS")
            more["type"] = self.type_()
            if self.take("FORMAT"):
                self.expr()
            self.need(")")
            return Node("cast", f"{name}<{more['type']}>", [e], more)
        if name == "EXTRACT":
            part = self.next().word
            if self.at("("):
                self.skip_parens()
            self.need("FROM")
            e = self.expr()
            self.need(")")
            return Node("call", name, [e], {"part": part})
        if name == "ARRAY" and (self.at("SELECT") or self.at("WITH")):
            q = self.query()
            self.need(")")
            return Node("subquery", "ARRAY", [q])
        args: list = []
        more["distinct"] = self.take("DISTINCT")
        if self.take("*"):
            args = [Node("star")]
        elif not self.at(")"):
            args = self.listed(self.argument, ")")
        if self.take("IGNORE") or self.take("RESPECT"):
            self.need("NULLS")
        if self.take("HAVING"):
            self.next()
            args.append(Node("steer", "", [self.expr()]))
        if self.take("ORDER", "BY"):
            more["order"] = self.ordering()
        if self.take("LIMIT"):
            self.expr()
        self.need(")")
        if self.take("IGNORE") or self.take("RESPECT"):
            self.need("NULLS")
        if self.take("OVER"):
            more["over"] = self.window() if self.at("(") else Node("window", self.word())
        return Node("call", name, args, more)

    def argument(self) -> Node:
        e = self.expr()
        if self.take("AS"):
            self.word()
        return e

    def window(self) -> Node:
        self.need("(")
        if self.peek().kind == "id" and self.peek().word not in ("PARTITION", "ORDER", "ROWS", "RANGE"):
            self.word()
        parts = self.listed(self.expr) if self.take("PARTITION", "BY") else []
        order = self.ordering() if self.take("ORDER", "BY") else []
        while not self.at(")"):
            self.i += 1
        self.need(")")
        return Node("window", "", [], {"partition": parts, "order": order})


def parse(sql: str) -> list[Node]:
    """The statements of a text as trees; SqlError where it can't be read."""
    return Parser(sql).statements()


def children(e: Node) -> list[Node]:
    """The expressions directly inside one; queries are left out."""
    out = [a for a in e.args if isinstance(a, Node) and e.kind != "column"]
    for key in ("order", "partition"):
        out += e.more.get(key) or []
    if e.kind == "case":
        out += [x for pair in e["whens"] for x in pair] + [x for x in (e["operand"], e["else"]) if x]
    if e.kind == "in" and isinstance(e["of"], list):
        out += e["of"]
    if e.more.get("over"):
        out.append(e.more["over"])
    return [x for x in out if x.kind != "query"]


def walk(e: Node):
    yield e
    for c in children(e):
        yield from walk(c)


def queries_in(e: Node) -> list[Node]:
    """The queries that stand directly in an expression."""
    out = []
    for x in walk(e):
        out += [a for a in x.args if isinstance(a, Node) and a.kind == "query"]
        if x.kind == "in" and isinstance(x["of"], Node):
            out.append(x["of"])
    return out


def is_aggregate(e: Node) -> bool:
    return e.kind == "call" and e.name in AGGREGATES and not e["over"]


def conjuncts(e: Node | None) -> list[Node]:
    return [] if e is None else conjuncts(e.args[0]) + conjuncts(e.args[1]) if e.kind == "and" else [e]


def show(e: Node, column=None) -> str:
    """An expression as text, one way for all that are equal; column(parts) writes its columns."""
    s = lambda x: show(x, column)
    inner = lambda x: f"({s(x)})" if x.kind in ("or", "and", "binary", "compare") else s(x)
    no = "NOT " if e["not"] else ""
    if e.kind == "column":
        return column(e.args) if column else ".".join(e.args)
    if e.kind == "literal":
        text = "'" + e.name.replace("'", "\\'") + "'" if e["text"] else e.name
        return f"{e['type']} {text}" if e["type"] else text
    if e.kind in ("constant", "param"):
        return e.name
    if e.kind == "star":
        return "*"
    if e.kind in ("and", "or"):
        return f" {e.kind.upper()} ".join(inner(a) if a.kind in ("and", "or") and a.kind != e.kind else s(a) for a in e.args)
    if e.kind == "not":
        return f"NOT {inner(e.args[0])}"
    if e.kind in ("compare", "binary"):
        return f"{inner(e.args[0])} {e.name} {inner(e.args[1])}"
    if e.kind == "unary":
        return e.name + inner(e.args[0])
    if e.kind == "in":
        return f"{inner(e.args[0])} {no}IN ({', '.join(map(s, e['of'])) if isinstance(e['of'], list) else 'SELECT'})"
    if e.kind == "between":
        return f"{inner(e.args[0])} {no}BETWEEN {s(e.args[1])} AND {s(e.args[2])}"
    if e.kind == "like":
        return f"{inner(e.args[0])} {no}LIKE {s(e.args[1])}"
    if e.kind == "is":
        return f"{inner(e.args[0])} IS {no}{e.name}"
    if e.kind == "case":
        whens = " ".join(f"WHEN {s(c)} THEN {s(v)}" for c, v in e["whens"])
        return "CASE " + (s(e["operand"]) + " " if e["operand"] else "") + whens + (f" ELSE {s(e['else'])}" if e["else"] else "") + " END"
    if e.kind == "cast":
        return f"{e.name.partition('<')[0]}({s(e.args[0])} AS {e['type']})"
    if e.kind == "interval":
        return f"INTERVAL {s(e.args[0])} {e.name}"
    if e.kind == "index":
        return f"{s(e.args[0])}[{s(e.args[1])}]"
    if e.kind == "field":
        return f"{s(e.args[0])}.{e.name}"
    if e.kind == "array":
        return f"[{', '.join(map(s, e.args))}]"
    if e.kind == "tuple":
        return f"({', '.join(map(s, e.args))})"
    if e.kind == "call":
        part = f"{e['part']} FROM " if e["part"] else "DISTINCT " if e["distinct"] else ""
        order = f" ORDER BY {', '.join(map(s, e['order']))}" if e["order"] else ""
        over = ""
        if e["over"]:
            w = e["over"]
            over = " OVER (" + " ".join([f"PARTITION BY {', '.join(map(s, w['partition']))}"] * bool(w["partition"]) + [f"ORDER BY {', '.join(map(s, w['order']))}"] * bool(w["order"])) + ")"
        return f"{e.name}({part}{', '.join(map(s, e.args))}{order}){over}"
    return "(SELECT)"
