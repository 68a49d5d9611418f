"""A compact ECMAScript parser: source text to a syntax tree.

It covers what bundles use: modules, classes with fields and private names, generators, async code,
destructuring, spread, templates, optional chaining, regular expressions and semicolon insertion.
Offsets count code points; :func:`utf16` turns them into UTF-16 units.  Errors raise
:class:`ParseError`; callers turn those into nulls, never into failed jobs.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator


class ParseError(ValueError):
    pass


class Node:
    """A syntax node; children are kept in the order in which a walk visits them."""

    def __init__(self, type: str, start: int, end: int = -1, **fields):
        self.type, self.start, self.end = type, start, end
        self.__dict__.update(fields)

    def get(self, name: str):
        return self.__dict__.get(name)

    def children(self) -> Iterator[tuple[str, Node]]:
        for name, x in self.__dict__.items():
            if isinstance(x, Node):
                yield name, x
            elif isinstance(x, list):
                for y in x:
                    if isinstance(y, Node):
                        yield name, y


IDENT = re.compile(r"(?:[A-Za-z_$]|[^\x00-\x7f\s]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})(?:[\w$\u200c\u200d]|[^\x00-\x7f\s]|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]+\})*")
NUMBER = re.compile(r"0[xX][0-9A-Fa-f_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?n?")
PUNCT = re.compile(r"\.\.\.|=>|>>>=|\*\*=|<<=|>>=|>>>|===|!==|&&=|\|\|=|\?\?=|\?\.(?!\d)|\*\*|\+\+|--|<<|>>|<=|>=|==|!=|&&|\|\||\?\?|\+=|-=|\*=|/=|%=|&=|\|=|\^=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")
BLANK = re.compile(r"(?:[\s\ufeff]+|//[^\n\r\u2028\u2029]*|/\*.*?\*/|<!--[^\n]*)", re.S)
ESCAPE = re.compile(r"\\(?:u\{([0-9A-Fa-f]+)\}|u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(\r\n|[\s\S]))")
SINGLE = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "v": "\v", "0": "\0", "\n": "", "\r\n": "", "\r": "", "\u2028": "", "\u2029": ""}
RESERVED = frozenset("break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false enum".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())


def _cooked(raw: str) -> str:
    def one(m: re.Match) -> str:
        if code := m[1] or m[2] or m[3]:
            return chr(int(code, 16))
        return SINGLE.get(m[4], m[4])

    text = ESCAPE.sub(one, raw)
    try:  # surrogate pairs become one character
        return text.encode("utf-16", "surrogatepass").decode("utf-16")
    except UnicodeDecodeError:
        return text.encode("utf-8", "replace").decode()


class Parser:
    def __init__(self, code: str, module: bool = True):
        self.code, self.size, self.module = code, len(code), module
        self.kind = self.value = ""
        self.start = self.end = self.last = 0
        self.newline = False
        self.depth = 0
        self.advance()

    # -- tokens

    def error(self, what: str = "unexpected token"):
        raise ParseError(f"{what} {self.value!r} at {self.start}")

    def advance(self) -> None:
        self.last = self.end
        at, code = self.end, self.code
        while m := BLANK.match(code, at):
            at = m.end()
        self.newline = "\n" in code[self.last : at] or "\r" in code[self.last : at]
        self.start = at
        if at >= self.size:
            self.kind, self.value, self.end = "eof", "", at
            return
        c = code[at]
        if m := IDENT.match(code, at):
            self.kind, self.value = "name", m[0]
        elif c.isdigit() or c == "." and code[at + 1 : at + 2].isdigit():
            m = NUMBER.match(code, at)
            self.kind, self.value = "number", m[0]
        elif c in "'\"":
            m = re.compile(rf"{c}(?:[^{c}\\\n]|\\[\s\S])*{c}").match(code, at)
            if not m:
                self.error("open string")
            self.kind, self.value = "string", m[0]
        elif c == "`":
            self.kind, self.value, self.end = "`", "`", at + 1
            return
        elif m := PUNCT.match(code, at):
            self.kind = self.value = m[0]
        else:
            self.kind = self.value = c
            self.error()
        self.end = m.end()

    def state(self):
        return self.kind, self.value, self.start, self.end, self.last, self.newline

    def restore(self, s) -> None:
        self.kind, self.value, self.start, self.end, self.last, self.newline = s

    def at(self, *what: str) -> bool:
        return self.kind in what if self.kind not in ("name", "string", "number") else self.kind == "name" and self.value in what

    def eat(self, what: str) -> bool:
        if self.at(what):
            self.advance()
            return True
        return False

    def need(self, what: str) -> None:
        if not self.eat(what):
            self.error(f"{what} expected, not")

    def semicolon(self) -> None:
        if not self.eat(";") and not self.at("}", "eof") and not self.newline:
            self.error()

    def done(self, node: Node) -> Node:
        node.end = self.last
        return node

    def peek(self):
        s = self.state()
        self.advance()
        out = self.kind, self.value, self.newline
        self.restore(s)
        return out

    def identifier(self, any_word: bool = False) -> Node:
        if self.kind != "name" or not any_word and self.value in RESERVED:
            self.error("name expected, not")
        node = Node("Identifier", self.start, name=self.value)
        self.advance()
        return self.done(node)

    # -- statements

    def program(self) -> Node:
        node = Node("Program", 0, body=[])
        while not self.at("eof"):
            node.body.append(self.statement())
        node.end = self.size
        return node

    def block(self) -> Node:
        node = Node("BlockStatement", self.start, body=[])
        self.need("{")
        while not self.at("}"):
            node.body.append(self.statement())
        self.advance()
        return self.done(node)

    def paren(self) -> Node:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    def statement(self) -> Node:
        self.depth += 1
        if self.depth > 400:
            self.error("nesting too deep at")
        out = self._statement()
        self.depth -= 1
        return out

    def _statement(self) -> Node:
        start, v = self.start, self.value
        if self.kind == "{":
            return self.block()
        if self.kind == ";":
            self.advance()
            return self.done(Node("EmptyStatement", start))
        if self.kind != "name":
            if self.at("@"):
                while self.eat("@"):
                    self.subscripts(self.primary(), start)
                return self.statement()
            return self.simple(start)
        if v in ("var", "const") or v == "let" and (self.peek()[0] in ("[", "{") or self.peek()[0] == "name" and self.peek()[1] not in ("in", "instanceof", "of")):
            node = self.declaration()
            self.semicolon()
            return self.done(node)
        if v == "function" or v == "async" and self.peek()[:2] == ("name", "function") and not self.peek()[2]:
            return self.function(True)
        if v == "class":
            return self.class_(True)
        if v == "import" and self.peek()[0] not in ("(", "."):
            return self.import_()
        if v == "export":
            return self.export()
        method = getattr(self, f"do_{v}", None) if v in RESERVED else None
        if method:
            return method(start)
        if v not in RESERVED and self.peek()[0] == ":":
            label = self.identifier()
            self.need(":")
            return self.done(Node("LabeledStatement", start, body=self.statement(), label_name=label.name))
        return self.simple(start)

    def simple(self, start: int) -> Node:
        node = Node("ExpressionStatement", start, expression=self.expression())
        self.semicolon()
        return self.done(node)

    def do_if(self, start: int) -> Node:
        self.advance()
        node = Node("IfStatement", start, test=self.paren(), consequent=self.statement(), alternate=None)
        if self.eat("else"):
            node.alternate = self.statement()
        return self.done(node)

    def do_for(self, start: int) -> Node:
        self.advance()
        wait = self.eat("await")
        self.need("(")
        init = None
        if self.at("var", "const") or self.at("let") and self.peek()[0] in ("[", "{", "name") and self.peek()[1] not in ("in", "of"):
            init = self.declaration(True)
        elif not self.at(";"):
            init = self.expression(True)
        if self.at("of", "in"):
            kind = "ForOfStatement" if self.value == "of" else "ForInStatement"
            self.advance()
            node = Node(kind, start, left=self.pattern_of(init), right=self.assignment() if kind == "ForOfStatement" else self.expression(), wait=wait)
        else:
            self.need(";")
            test = None if self.at(";") else self.expression()
            self.need(";")
            node = Node("ForStatement", start, init=init, test=test, update=None if self.at(")") else self.expression())
        self.need(")")
        node.body = self.statement()
        return self.done(node)

    def do_while(self, start: int) -> Node:
        self.advance()
        return self.done(Node("WhileStatement", start, test=self.paren(), body=self.statement()))

    def do_do(self, start: int) -> Node:
        self.advance()
        node = Node("DoWhileStatement", start, body=self.statement())
        self.need("while")
        node.test = self.paren()
        self.eat(";")
        return self.done(node)

    def do_return(self, start: int, kind: str = "ReturnStatement") -> Node:
        self.advance()
        node = Node(kind, start, argument=None)
        if not self.at(";", "}", "eof") and not self.newline:
            node.argument = self.expression()
        self.semicolon()
        return self.done(node)

    def do_throw(self, start: int) -> Node:
        return self.do_return(start, "ThrowStatement")

    def do_break(self, start: int) -> Node:
        node = Node("BreakStatement" if self.value == "break" else "ContinueStatement", start)
        self.advance()
        if self.kind == "name" and not self.newline and self.value not in RESERVED:
            self.advance()
        self.semicolon()
        return self.done(node)

    do_continue = do_break

    def do_try(self, start: int) -> Node:
        self.advance()
        node = Node("TryStatement", start, block=self.block(), handler=None, finalizer=None)
        if self.at("catch"):
            at = self.start
            self.advance()
            param = None
            if self.eat("("):
                param = self.pattern()
                self.need(")")
            node.handler = self.done(Node("CatchClause", at, param=param, body=self.block()))
        if self.eat("finally"):
            node.finalizer = self.block()
        if not node.handler and not node.finalizer:
            self.error("catch expected, not")
        return self.done(node)

    def do_switch(self, start: int) -> Node:
        self.advance()
        node = Node("SwitchStatement", start, discriminant=self.paren(), cases=[])
        self.need("{")
        while not self.eat("}"):
            case = Node("SwitchCase", self.start, test=None, consequent=[])
            if not self.eat("default"):
                self.need("case")
                case.test = self.expression()
            self.need(":")
            while not self.at("case", "default", "}"):
                case.consequent.append(self.statement())
            node.cases.append(self.done(case))
        return self.done(node)

    def do_debugger(self, start: int) -> Node:
        self.advance()
        self.semicolon()
        return self.done(Node("DebuggerStatement", start))

    def do_with(self, start: int) -> Node:
        self.advance()
        return self.done(Node("WithStatement", start, object=self.paren(), body=self.statement()))

    def declaration(self, in_for: bool = False) -> Node:
        node = Node("VariableDeclaration", self.start, kind=self.value, declarations=[])
        self.advance()
        while True:
            d = Node("VariableDeclarator", self.start, id=self.pattern(), init=None)
            if self.eat("="):
                d.init = self.assignment(in_for)
            elif not in_for and d.id.type != "Identifier":
                self.error("initializer expected, not")
            node.declarations.append(self.done(d))
            if not self.eat(","):
                return self.done(node)

    def import_(self) -> Node:
        node = Node("ImportDeclaration", self.start, specifiers=[], source=None)
        if not self.module:
            self.error()
        self.advance()
        if self.kind != "string":
            if self.kind == "name":
                local = self.identifier()
                node.specifiers.append(Node("ImportDefaultSpecifier", local.start, local.end, local=local))
                self.eat(",")
            if self.at("*"):
                at = self.start
                self.advance()
                self.need("as")
                node.specifiers.append(self.done(Node("ImportNamespaceSpecifier", at, local=self.identifier())))
            elif self.eat("{"):
                while not self.eat("}"):
                    at = self.start
                    if self.kind == "string":
                        self.advance()
                        self.need("as")
                        local = self.identifier()
                    else:
                        local = self.identifier(True)
                        if self.eat("as"):
                            local = self.identifier()
                    node.specifiers.append(self.done(Node("ImportSpecifier", at, local=local)))
                    if not self.at("}"):
                        self.need(",")
            self.need("from")
        node.source = self.string()
        self.attributes()
        self.semicolon()
        return self.done(node)

    def attributes(self) -> None:
        if self.at("with", "assert") and self.peek()[0] == "{":
            self.advance()
            self.primary()

    def string(self) -> Node:
        if self.kind != "string":
            self.error("string expected, not")
        node = Node("Literal", self.start, value=_cooked(self.value[1:-1]))
        self.advance()
        return self.done(node)

    def export(self) -> Node:
        start = self.start
        if not self.module:
            self.error()
        self.advance()
        if self.eat("*"):
            if self.eat("as"):
                self.advance()
            self.need("from")
            node = Node("ExportAllDeclaration", start, source=self.string())
            self.attributes()
            self.semicolon()
            return self.done(node)
        if self.eat("default"):
            if self.at("function") or self.at("async") and self.peek()[1] == "function":
                inner = self.function(True, True)
            elif self.at("class"):
                inner = self.class_(True)
            else:
                inner = self.assignment()
                self.semicolon()
            return self.done(Node("ExportDefaultDeclaration", start, declaration=inner))
        node = Node("ExportNamedDeclaration", start, declaration=None, specifiers=[], source=None)
        if self.eat("{"):
            while not self.eat("}"):
                local = self.string() if self.kind == "string" else self.identifier(True)
                spec = Node("ExportSpecifier", local.start, local=local)
                if self.eat("as"):
                    self.advance()
                node.specifiers.append(self.done(spec))
                if not self.at("}"):
                    self.need(",")
            if self.eat("from"):
                node.source = self.string()
                self.attributes()
            self.semicolon()
        else:
            node.declaration = self.statement()
            if "Declaration" not in node.declaration.type:
                self.error("declaration expected before")
        return self.done(node)

    # -- functions and classes

    def function(self, is_statement: bool, nameless: bool = False) -> Node:
        node = Node("FunctionDeclaration" if is_statement else "FunctionExpression", self.start, id=None)
        self.eat("async")
        self.need("function")
        self.eat("*")
        if self.kind == "name" and not self.at("("):
            node.id = self.identifier(self.value in ("yield", "await"))
        elif is_statement and not nameless:
            self.error("name expected, not")
        node.params = self.params()
        node.body = self.block()
        return self.done(node)

    def params(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.eat(")"):
            out.append(self.rest() if self.at("...") else self.pattern_default())
            if not self.at(")"):
                self.need(",")
        return out

    def rest(self) -> Node:
        node = Node("RestElement", self.start)
        self.advance()
        node.argument = self.pattern()
        return self.done(node)

    def pattern_default(self) -> Node:
        start, left = self.start, self.pattern()
        if self.eat("="):
            return self.done(Node("AssignmentPattern", start, left=left, right=self.assignment()))
        return left

    def pattern(self) -> Node:
        start = self.start
        if self.eat("["):
            node = Node("ArrayPattern", start, elements=[])
            while not self.eat("]"):
                if self.eat(","):
                    continue
                node.elements.append(self.rest() if self.at("...") else self.pattern_default())
                if not self.at("]"):
                    self.need(",")
            return self.done(node)
        if self.eat("{"):
            node = Node("ObjectPattern", start, properties=[])
            while not self.eat("}"):
                at = self.start
                if self.at("..."):
                    node.properties.append(self.rest())
                else:
                    key, computed = self.key()
                    prop = Node("Property", at, key=key, computed=computed, shorthand=False)
                    if self.eat(":"):
                        prop.value = self.pattern_default()
                    else:
                        if computed or key.type != "Identifier" or key.name in RESERVED:
                            self.error()
                        prop.shorthand = True
                        prop.value = Node("Identifier", key.start, key.end, name=key.name)
                        if self.eat("="):
                            prop.value = self.done(Node("AssignmentPattern", at, left=prop.value, right=self.assignment()))
                    node.properties.append(self.done(prop))
                if not self.at("}"):
                    self.need(",")
            return self.done(node)
        return self.identifier()

    def key(self) -> tuple[Node, bool]:
        start = self.start
        if self.eat("["):
            inner = self.assignment()
            self.need("]")
            return inner, True
        if self.kind == "string":
            return self.string(), False
        if self.kind == "number":
            self.advance()
            return self.done(Node("Literal", start, value=None)), False
        if self.eat("#"):
            name = self.identifier(True)
            return self.done(Node("PrivateIdentifier", start, name=name.name)), False
        return self.identifier(True), False

    def class_(self, is_statement: bool) -> Node:
        node = Node("ClassDeclaration" if is_statement else "ClassExpression", self.start, id=None, superClass=None)
        self.advance()
        if self.kind == "name" and self.value not in ("extends",):
            node.id = self.identifier()
        if self.eat("extends"):
            node.superClass = self.subscripts(self.primary(), self.start)
        body = Node("ClassBody", self.start, body=[])
        self.need("{")
        while not self.eat("}"):
            if not self.eat(";"):
                body.body.append(self.member())
        node.body = self.done(body)
        return self.done(node)

    def member(self) -> Node:
        start = self.start
        while self.eat("@"):
            self.subscripts(self.primary(), start)
        ends = ("(", "=", ";", "}")
        if self.at("static") and self.peek()[0] not in ends:
            self.advance()
            if self.at("{"):
                node = self.block()
                node.type = "StaticBlock"
                return node
        star = False
        for word in ("async", "get", "set", "accessor"):
            if self.at(word) and self.peek()[0] not in ends and not (word == "async" and self.peek()[2]):
                self.advance()
                break
        star = self.eat("*") or star
        key, computed = self.key()
        if self.at("("):
            return self.done(Node("MethodDefinition", start, key=key, computed=computed, value=self.method()))
        value = self.assignment() if self.eat("=") else None
        self.semicolon()
        return self.done(Node("PropertyDefinition", start, key=key, computed=computed, value=value))

    def method(self) -> Node:
        return self.done(Node("FunctionExpression", self.start, id=None, params=self.params(), body=self.block()))

    # -- expressions

    def expression(self, no_in: bool = False) -> Node:
        start, first = self.start, self.assignment(no_in)
        if not self.at(","):
            return first
        node = Node("SequenceExpression", start, expressions=[first])
        while self.eat(","):
            node.expressions.append(self.assignment(no_in))
        return self.done(node)

    def arrow(self, start: int, params: list[Node], no_in: bool) -> Node:
        if self.newline:
            self.error()
        self.need("=>")
        body = self.block() if self.at("{") else self.assignment(no_in)
        return self.done(Node("ArrowFunctionExpression", start, params=params, body=body))

    def assignment(self, no_in: bool = False) -> Node:
        self.depth += 1
        if self.depth > 400:
            self.error("nesting too deep at")
        out = self._assignment(no_in)
        self.depth -= 1
        return out

    def _assignment(self, no_in: bool) -> Node:
        start = self.start
        if self.kind == "name":
            if self.at("yield") and self.peek()[0] not in ("=>", "=", ".", ":"):
                self.advance()
                node = Node("YieldExpression", start, argument=None)
                star = not self.newline and self.eat("*")
                if star or not self.newline and not self.at(")", "]", "}", ",", ";", ":", "eof", "in", "of"):
                    node.argument = self.assignment(no_in)
                return self.done(node)
            if self.at("async"):
                kind, value, newline = self.peek()
                if not newline and kind == "name" and value not in RESERVED and value not in ("in", "of", "instanceof"):
                    saved = self.state()
                    self.advance()
                    param = self.identifier()
                    if self.at("=>"):
                        return self.arrow(start, [param], no_in)
                    self.restore(saved)
                elif kind == "(" and not newline and (node := self.try_arrow(start, no_in, True)):
                    return node
            if self.value not in RESERVED and self.peek()[0] == "=>":
                return self.arrow(start, [self.identifier()], no_in)
        elif self.kind == "(" and (node := self.try_arrow(start, no_in)):
            return node
        left = self.conditional(no_in)
        if self.kind in ASSIGN:
            op = self.kind
            if op == "=":
                left = self.pattern_of(left)
            elif left.type not in ("Identifier", "MemberExpression"):
                self.error()
            self.advance()
            return self.done(Node("AssignmentExpression", start, operator=op, left=left, right=self.assignment(no_in)))
        return left

    def closes_before_arrow(self) -> bool:
        """Whether the parenthesis here ends before an arrow, by a quick scan; strings are skipped."""
        depth, at = 0, self.start
        scan = re.compile(r"[(){}\[\]]|=>|'(?:[^'\\\n]|\\.)*'|\"(?:[^\"\\\n]|\\.)*\"|`|/[/*]")
        while m := scan.search(self.code, at):
            c = m[0]
            at = m.end()
            if c in "([{":
                depth += 1
            elif c in ")]}":
                depth -= 1
                if not depth:
                    while b := BLANK.match(self.code, at):
                        at = b.end()
                    return self.code.startswith("=>", at)
            elif c in ("`", "//", "/*"):
                return True  # not sure: try
        return False

    def try_arrow(self, start: int, no_in: bool, is_async: bool = False) -> Node | None:
        saved, depth = self.state(), self.depth
        if is_async:
            self.advance()
        if self.closes_before_arrow():
            try:
                params = self.params()
                if self.at("=>") and not self.newline:
                    return self.arrow(start, params, no_in)
            except ParseError:
                if self.code.find("=>", saved[2]) < 0:
                    raise
        self.depth = depth
        self.restore(saved)
        return None

    def pattern_of(self, node: Node) -> Node:
        """An expression read as an assignment target."""
        if node.type == "ArrayExpression":
            node.type = "ArrayPattern"
            node.elements = [self.pattern_of(x) for x in node.elements]
        elif node.type == "ObjectExpression":
            node.type = "ObjectPattern"
            for p in node.properties:
                if p.type == "SpreadElement":
                    self.pattern_of(p)
                else:
                    p.value = self.pattern_of(p.value)
        elif node.type == "SpreadElement":
            node.type = "RestElement"
            node.argument = self.pattern_of(node.argument)
        elif node.type == "AssignmentExpression" and node.operator == "=":
            node.type = "AssignmentPattern"
        elif node.type not in ("Identifier", "MemberExpression", "AssignmentPattern", "VariableDeclaration", "ArrayPattern", "ObjectPattern"):
            self.error("no target before")
        return node

    def conditional(self, no_in: bool) -> Node:
        start, test = self.start, self.binary(0, no_in)
        if not self.eat("?"):
            return test
        yes = self.assignment()
        self.need(":")
        return self.done(Node("ConditionalExpression", start, test=test, consequent=yes, alternate=self.assignment(no_in)))

    def binary(self, least: int, no_in: bool) -> Node:
        start = self.start
        if self.at("#"):  # #field in object
            left, _ = self.key()
        else:
            left = self.unary()
        while True:
            op = self.value if self.kind == "name" else self.kind
            rank = BINARY.get(op, 0) if self.kind != "string" else 0
            if rank <= least and not (op == "**" and rank == least) or not rank or no_in and op == "in":
                return left
            self.advance()
            right = self.binary(rank - (op == "**"), no_in)
            left = self.done(Node("LogicalExpression" if op in ("&&", "||", "??") else "BinaryExpression", start, left=left, right=right, operator=op))

    def unary(self) -> Node:
        start = self.start
        if self.kind in ("!", "~", "+", "-") or self.at("typeof", "void", "delete"):
            op = self.value
            self.advance()
            return self.done(Node("UnaryExpression", start, argument=self.unary(), operator=op))
        if self.kind in ("++", "--"):
            self.advance()
            return self.done(Node("UpdateExpression", start, argument=self.unary()))
        if self.at("await") and self.peek()[0] not in ("=>", "=", ".", ":", ")", ",", ";"):
            self.advance()
            return self.done(Node("AwaitExpression", start, argument=self.unary()))
        node = self.subscripts(self.primary(), start)
        if self.kind in ("++", "--") and not self.newline:
            self.advance()
            node = self.done(Node("UpdateExpression", start, argument=node))
        return node

    def arguments(self) -> list[Node]:
        self.need("(")
        out = []
        while not self.eat(")"):
            out.append(self.spread() if self.at("...") else self.assignment())
            if not self.at(")"):
                self.need(",")
        return out

    def spread(self) -> Node:
        node = Node("SpreadElement", self.start)
        self.advance()
        node.argument = self.assignment()
        return self.done(node)

    def subscripts(self, node: Node, start: int, calls: bool = True) -> Node:
        start = node.start if node.start < start else start
        while True:
            if self.eat("."):
                prop, _ = self.key()
                node = self.done(Node("MemberExpression", start, object=node, property=prop, computed=False))
            elif self.at("?.") and calls:
                self.advance()
                if self.at("("):
                    node = self.done(Node("CallExpression", start, callee=node, arguments=self.arguments()))
                elif self.eat("["):
                    inner = self.expression()
                    self.need("]")
                    node = self.done(Node("MemberExpression", start, object=node, property=inner, computed=True))
                else:
                    prop, _ = self.key()
                    node = self.done(Node("MemberExpression", start, object=node, property=prop, computed=False))
            elif self.eat("["):
                inner = self.expression()
                self.need("]")
                node = self.done(Node("MemberExpression", start, object=node, property=inner, computed=True))
            elif self.at("(") and calls:
                node = self.done(Node("CallExpression", start, callee=node, arguments=self.arguments()))
            elif self.at("`"):
                node = self.done(Node("TaggedTemplateExpression", start, tag=node, quasi=self.template()))
            else:
                return node

    def template(self) -> Node:
        node = Node("TemplateLiteral", self.start, quasis=[], expressions=[])
        at = self.start + 1
        part = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*")
        while True:
            m = part.match(self.code, at)
            node.quasis.append(Node("TemplateElement", at, m.end(), cooked=_cooked(m[0].replace("\r\n", "\n"))))
            self.end = m.end()
            if self.code.startswith("`", m.end()):
                self.end += 1
                self.advance()
                return self.done(node)
            if not self.code.startswith("${", m.end()):
                self.error("open template")
            self.end += 2
            self.advance()
            node.expressions.append(self.expression())
            if not self.at("}"):
                self.error()
            at = self.start + 1

    def regex(self) -> Node:
        m = re.compile(r"/(?:[^/\\\[\n]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*").match(self.code, self.start)
        if not m:
            self.error("open regular expression")
        node = Node("Literal", self.start, value=None)
        self.end = m.end()
        self.advance()
        return self.done(node)

    def primary(self) -> Node:
        start, kind, v = self.start, self.kind, self.value
        if kind == "string":
            return self.string()
        if kind == "number":
            self.advance()
            return self.done(Node("Literal", start, value=None))
        if kind == "`":
            return self.template()
        if kind in ("/", "/="):
            return self.regex()
        if kind == "(":
            self.advance()
            node = self.expression()
            self.need(")")
            return node
        if kind == "[":
            self.advance()
            node = Node("ArrayExpression", start, elements=[])
            while not self.eat("]"):
                if self.eat(","):
                    continue
                node.elements.append(self.spread() if self.at("...") else self.assignment())
                if not self.at("]"):
                    self.need(",")
            return self.done(node)
        if kind == "{":
            return self.object()
        if kind == "@":
            while self.eat("@"):
                self.subscripts(self.primary(), start)
            return self.class_(False)
        if kind != "name":
            self.error()
        if v == "function" or v == "async" and self.peek()[:2] == ("name", "function") and not self.peek()[2]:
            return self.function(False)
        if v == "class":
            return self.class_(False)
        if v == "new":
            self.advance()
            if self.eat("."):
                self.advance()
                return self.done(Node("MetaProperty", start))
            callee = self.subscripts(self.primary(), self.start, calls=False)
            return self.done(Node("NewExpression", start, callee=callee, arguments=self.arguments() if self.at("(") else []))
        if v in ("this", "super"):
            self.advance()
            return self.done(Node("ThisExpression" if v == "this" else "Super", start))
        if v in ("null", "true", "false"):
            self.advance()
            return self.done(Node("Literal", start, value=None))
        if v == "import":
            self.advance()
            if self.eat("."):
                self.advance()
                return self.done(Node("MetaProperty", start))
            return self.done(Node("ImportExpression", start, arguments=self.arguments()))
        return self.identifier()

    def object(self) -> Node:
        node = Node("ObjectExpression", self.start, properties=[])
        self.need("{")
        ends = (",", "}", ":", "(", "=")
        while not self.eat("}"):
            start = self.start
            if self.at("..."):
                node.properties.append(self.spread())
            else:
                for word in ("async", "get", "set"):
                    if self.at(word) and self.peek()[0] not in ends:
                        self.advance()
                        break
                self.eat("*")
                key, computed = self.key()
                prop = Node("Property", start, key=key, computed=computed, shorthand=False)
                if self.at("("):
                    prop.value = self.method()
                elif self.eat(":"):
                    prop.value = self.assignment()
                else:
                    if computed or key.type != "Identifier":
                        self.error()
                    prop.shorthand = True
                    prop.value = Node("Identifier", key.start, key.end, name=key.name)
                    if self.eat("="):
                        prop.value = self.done(Node("AssignmentPattern", start, left=prop.value, right=self.assignment()))
                node.properties.append(self.done(prop))
            if not self.at("}"):
                self.need(",")
        return self.done(node)


def parse(code: str, module: bool = True) -> Node:
    """The program in ``code``; raises :class:`ParseError`."""
    try:
        return Parser(code, module).program()
    except RecursionError as e:
        raise ParseError("nesting too deep") from e


def parses(code: str | None) -> bool:
    """Whether the text is a module or a script."""
    for module in (True, False):
        try:
            parse(code or "", module)
            return True
        except ParseError:
            pass
    return False


PATTERNS = frozenset(("ObjectPattern", "ArrayPattern", "AssignmentPattern", "RestElement"))
#: Fields that hold binding or assignment targets.
TARGETS = {"VariableDeclarator": {"id"}, "FunctionDeclaration": {"id", "params"}, "FunctionExpression": {"id", "params"}, "ArrowFunctionExpression": {"params"}, "ClassDeclaration": {"id"}, "ClassExpression": {"id"}, "CatchClause": {"param"}, "AssignmentExpression": {"left"}, "ForInStatement": {"left"}, "ForOfStatement": {"left"}, "ArrayPattern": {"elements"}, "AssignmentPattern": {"left"}, "RestElement": {"argument"}}
SKIPPED = frozenset(("ImportSpecifier", "ImportDefaultSpecifier", "ImportNamespaceSpecifier", "ExportSpecifier", "PrivateIdentifier", "TemplateElement"))


def walk(root: Node) -> Iterator[tuple[Node, Node | None, str, bool]]:
    """``(node, parent, field, is_target)`` in post-order.

    Property names and labels are left out, as are import and export specifiers; identifiers that
    are bound or assigned to come with ``is_target``.
    """
    stack: list[tuple[Node, Node | None, str, bool, bool]] = [(root, None, "", False, False)]
    while stack:
        node, parent, name, target, seen = stack.pop()
        if seen:
            yield node, parent, name, target
            continue
        stack.append((node, parent, name, target, True))
        below = []
        targets = TARGETS.get(node.type, ())
        for field, x in node.children():
            if x.type in SKIPPED:
                continue
            if not node.get("computed") and (field == "key" and node.type in ("Property", "MethodDefinition", "PropertyDefinition") or field == "property" and node.type == "MemberExpression"):
                continue
            t = field in targets or field == "value" and target and node.type == "Property" or field == "properties" and node.type == "ObjectPattern"
            below.append((x, node, field, t, False))
        stack.extend(reversed(below))


def pattern_names(node: Node | None) -> list[str]:
    """Names that a pattern binds; names under a default value are not looked for."""
    if node is None:
        return []
    if node.type == "Identifier":
        return [node.name]
    if node.type == "ObjectPattern":
        return [n for p in node.properties for n in pattern_names(p.argument if p.type == "RestElement" else p.value)]
    if node.type == "ArrayPattern":
        return [n for e in node.elements for n in pattern_names(e)]
    if node.type == "RestElement":
        return pattern_names(node.argument)
    return []


def line_starts(code: str) -> list[int]:
    return [0, *(m.end() for m in re.finditer(r"\r\n|[\n\r\u2028\u2029]", code))]


def line_of(starts: list[int], at: int) -> int:
    return bisect_right(starts, at)


def utf16(code: str) -> list[int] | None:
    """Offsets of characters that take two UTF-16 units, or None if there are none."""
    wide = [k for k, c in enumerate(code) if c > "\uffff"]
    return wide or None


def units(wide: list[int] | None, a: int, b: int) -> int:
    """Length in UTF-16 units of ``code[a:b]``."""
    return b - a + (bisect_right(wide, b - 1) - bisect_right(wide, a - 1) if wide else 0)
