"""Lexers and grammars of the supported languages, for the generalised parser.

Grammars describe structure: declarations, statements, expressions and their nesting. Operators have no
precedence and names no meaning, since neither decides whether a text parses. Dialects of a language are
alternatives of one grammar (module and script; declarations, statements or both at file level).
"""

from __future__ import annotations

import re

from weftgraph.llm.gll import Grammar

_ID = r"[^\W\d]\w*"
_NUM = r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO]?[0-7_]+(?![.\d])|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)"


class Language:
    """``skip`` is dropped, ``token`` alternatives are kept; a word is a literal of the grammar or an ID."""

    newline = False

    def __init__(self, name: str, grammar: str, starts: list[str], hard: str, skip: str, token: str):
        self.name = name
        self.grammar = Grammar(grammar, starts, set(hard.split()))
        self.find = re.compile(rf"(?:{skip})*+({token}|[\s\S]|\Z)").findall
        self.known: dict[str, int] = {}
        t = self.grammar.term
        self.ID, self.NUM, self.STR, self.CHAR, self.NL, self.ERR, self.REGEX = (t(x) for x in ("ID", "NUM", "STR", "CHAR", "NL", "ERR", "REGEX"))

    def classify(self, text: str) -> int:
        known = self.grammar.terms.get(text)
        if known is not None and not text.isupper():
            return known
        c = text[0]
        if c == "\n":
            return self.NL
        if c.isdigit() or (c == "." and len(text) > 1 and text[1].isdigit()):
            return self.NUM
        return self.other(text, c)

    def other(self, text: str, c: str) -> int:
        if len(text) > 1 and text[-1] in "\"'`":
            return self.CHAR if c == "'" else self.STR
        if c.isalpha() or c in "_$@":
            return self.ID
        return self.ERR

    def classes(self, text: str) -> list[int]:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        out = []
        add = out.append
        for t in self.find(text):
            c = known.get(t)
            if c is None:
                if not t:
                    break
                c = known[t] = self.classify(t)
            add(c)
        return out

    def parses(self, text: str) -> bool:
        if "\0" in text:
            return False
        return self.grammar.accepts(self.classes(text))


class Json(Language):
    pass


class Newlines(Language):
    """Newlines end statements between certain classes."""

    def __init__(self, *a, enders: str, starters: str | None = None, never: str = "", emit: str = "NL"):
        super().__init__(*a)
        terms = self.grammar.terms
        self.enders = {terms[x] for x in enders.split() if x in terms} | {k for w, k in terms.items() if k in self.grammar.soft}
        self.enders |= {terms[x] for x in ("ID", "NUM", "STR", "CHAR", "REGEX")}
        self.never = {terms[x] for x in never.split() if x in terms}
        self.emit = self.grammar.term(emit)
        words = {k for w, k in terms.items() if w[0].isalpha() and w[0].islower()}
        self.starters = None if starters is None else ({terms[x] for x in starters.split() if x in terms} | {terms[x] for x in ("ID", "NUM", "STR", "CHAR")} | words) - self.never

    def classes(self, text: str) -> list[int]:
        raw = super().classes(text)
        nl, enders, emit, starters, never = self.NL, self.enders, self.emit, self.starters, self.never
        out: list[int] = []
        add = out.append
        last, pending = -1, False
        for c in raw:
            if c == nl:
                pending = last in enders
                continue
            if pending:
                pending = False
                if (c in starters) if starters is not None else (c not in never):
                    add(emit)
            add(c)
            last = c
        if starters is None and last in enders:
            add(emit)
        return out


# ---------------------------------------------------------------- JSON

JSON = Json("json", "file = value ; value = STR | NUM | 'true' | 'false' | 'null' | '[' (value (',' value)*)? ']' | '{' (pair (',' pair)*)? '}' ; pair = STR ':' value ;", ["file"], "true false null", r"[ \t\r\n]+", r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|[{}\[\]:,]|\w+')


def _json_other(self: Language, text: str, c: str) -> int:
    return self.NUM if c == "-" and len(text) > 1 else self.STR if c == '"' and len(text) > 1 else self.ERR


Json.other = _json_other
Json.classify = lambda self, text: self.grammar.terms[text] if text in self.grammar.terms and not text.isupper() else self.NUM if text[0].isdigit() and not text[-1].isalpha() else self.other(text, text[0])

# ---------------------------------------------------------------- JavaScript and TypeScript


def _script(ts: bool) -> str:
    ann = "(':' type)?" if ts else ""
    opt = "'?'?" if ts else ""
    gen = "tparams?" if ts else ""
    mods = "( 'public' | 'private' | 'protected' | 'readonly' | 'abstract' | 'override' | 'declare' )*" if ts else ""
    heritage = "('extends' postfix targs?)? ('implements' type (',' type)*)?" if ts else "('extends' postfix)?"
    return f"""
file = seq? ;
seq = (blockish | simple stop | stop)+ simple? | simple ;
stop = ';' | NL ;
block = '{{' seq? '}}' ;
body = NL? one ;
one = blockish | simple stop? | ';' ;
blockish = block | function | class | 'if' '(' expr ')' body (NL? 'else' body)? | for | 'while' '(' expr ')' body | switch | try | ID ':' body
  | 'export' 'default'? (function | class) | decorators 'export'? 'default'? class
  {"| 'export'? 'declare'? ('interface' name tparams? ('extends' type (',' type)*)? tbody | 'const'? 'enum' name '{' (emember (',' emember)* ','?)? '}' | ('namespace' | 'module') (name ('.' name)* | STR) block) | 'export'? 'declare' (class | 'global' block) | 'export'? 'abstract' class | 'export'? 'default'? sig" if ts else ""} ;
for = 'for' 'await'? '(' ( (decl | expr)? ';' expr? ';' expr? | (('var' | 'let' | 'const') pattern | expr) ('of' | 'in') expr ) ')' body ;
switch = 'switch' '(' expr ')' '{{' (('case' expr | 'default') ':' seq?)* '}}' ;
try = 'try' block NL? ( 'catch' ('(' pattern {ann} ')')? block (NL? 'finally' block)? | 'finally' block ) ;
simple = expr | decl | 'return' expr? | 'break' ID? | 'continue' ID? | 'throw' expr | 'debugger' | 'do' body NL? 'while' '(' expr ')' | import | export {"| 'export'? 'declare'? 'type' name tparams? '=' type | sig | 'declare' decl | 'export' '=' expr | 'import' name '=' expr | 'export' 'as' 'namespace' name" if ts else ""} ;
import = 'import' (STR | iclause 'from' STR) ('with' object)? ;
iclause = {"'type'?" if ts else ""} ( ID (',' (star | names))? | star | names ) ;
star = '*' 'as' name ;
names = '{{' (item (',' item)* ','?)? '}}' ;
item = {"'type'?" if ts else ""} (name | STR) ('as' (name | STR))? ;
export = 'export' ( 'default' assign | decl | {"'type'?" if ts else ""} (names | '*' ('as' name)?) ('from' STR)? ) ;
decl = ('var' | 'let' | 'const') binding (',' binding)* ;
binding = pattern {"'!'?" if ts else ""} {ann} ('=' assign)? ;
pattern = ID | '[' (pelem | ',')* ']' | '{{' (pprop (',' pprop)* ','?)? '}}' ;
pelem = '...'? pattern ('=' assign)? ;
pprop = '...' pattern | ID ('=' assign)? | key ':' pattern ('=' assign)? ;
function = 'async'? 'function' '*'? ID? {gen} params {ann} block ;
params = '(' (param (',' param)* ','?)? ')' ;
param = {"decorators?" if ts else ""} {mods} '...'? (pattern {"| 'this'" if ts else ""}) {opt} {ann} ('=' assign)? ;
class = 'class' ID? {gen} {heritage} '{{' (member | ';' | NL)* '}}' ;
decorators = ('@' postfix NL?)+ ;
member = decorators? {mods} ( 'static' block | 'static'? {mods} ( ('get' | 'set' | 'async' '*'? | '*')? key {opt} {gen} params {ann} (block {"| stop" if ts else ""}) | key {"('?' | '!')?" if ts else ""} {ann} ('=' assign)? (stop)? {"| '[' ID ':' type ']' ann stop?" if ts else ""} ) ) ;
key = name | STR | NUM | '[' assign ']' | PRIVATE ;
name = ID | KEYWORD ;
expr = assign (',' assign)* ;
assign = arrow | 'yield' ('*'? assign)? | cond ;
arrow = 'async'? ( ID | {gen} params {ann} ) '=>' (block | assign) ;
cond = binary ('?' assign ':' assign)? (aop assign)? ;
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>' '>' '=' | '>' '>' '>' '=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
binary = unary (bop unary)* ;
bop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '<=' | '>' ('>' '>'?)? '='? | '<<' | '&' | '|' | '^' | '&&' | '||' | '??' | 'in' | 'instanceof' ;
unary = ('!' | '~' | '+' | '-' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' {"| targs" if ts else ""})* postfix ;
postfix = primary suffix* ('++' | '--')? {"(('as' | 'satisfies') (type | 'const'))*" if ts else ""} ;
suffix = '.' (name | PRIVATE) | '?.' (name | PRIVATE | '[' expr ']' | args) | '[' expr ']' | args | STR {"| '!' | targs args" if ts else ""} ;
args = '(' (arg (',' arg)* ','?)? ')' ;
arg = '...'? assign ;
primary = ID | NUM | STR | CHAR | REGEX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' expr ')' | '[' (arg | ',')* ']' | object | function | class | 'new' ('.' ID | newtarget) | 'import' ('(' assign ')' | '.' ID) | PRIVATE ;
newtarget = 'new'? primary ('.' (name | PRIVATE) | '[' expr ']')* {"targs?" if ts else ""} args? ;
object = '{{' (prop (',' prop)* ','?)? '}}' ;
prop = ('get' | 'set' | 'async' '*'? | '*')? key {gen} params {ann} block | key ':' assign | ID ('=' assign)? | '...' assign ;
""" + ("""
ann = ':' type ;
sig = 'async'? 'function' '*'? ID tparams? params (':' type)? stop ;
emember = key ('=' assign)? ;
tparams = '<' tparam (',' tparam)* ','? '>' ;
tparam = ('const' | 'in' | 'out')* name ('extends' type)? ('=' type)? ;
targs = '<' type (',' type)* ','? '>' ;
type = ftype | tunion ('extends' tunion '?' type ':' type)? | ('asserts')? (ID | 'this') 'is' type | 'asserts' (ID | 'this') ;
ftype = 'abstract'? 'new'? tparams? params '=>' type ;
tunion = ('|' | '&')? tpost (('|' | '&') tpost)* ;
tpost = ('keyof' | 'readonly' | 'unique' | 'infer')* tprim ('[' type? ']')* ;
tprim = (ID | 'this' | 'void' | 'null' | 'typeof' name | 'true' | 'false' | 'import' '(' STR ')') ('.' name)* targs? | STR | CHAR | '-'? NUM | '(' type ')' | '[' (telem (',' telem)* ','?)? ']' | tbody ;
telem = '...'? (name '?'? ':')? type '?'? ;
tbody = '{' (tmember? (',' | ';' | NL))* tmember? '}' ;
tmember = ('readonly' | '+' | '-' | 'get' | 'set' | 'static')* ( key '?'? (tparams? params)? (':' type)? | 'new'? tparams? params (':' type)? | '[' name ('in' | ':') type ('as' type)? ']' ('-' | '+')? '?'? (':' type)? ) ;
""" if ts else "")


_JS_HARD = "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum"
_JS_OPS = r">|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|\.\.\.|[{}()\[\];,<+\-*/%&|^!~?:=.@]"
_JS_REGEX = r"(?:(?<=[=(,:\[!&|?{};\n+*%~^])|(?<=[=(,:\[!&|?{};+*%~^>] )|(?<=return )|(?<=typeof )|(?<=\n  )|(?<=case ))/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*"
_JS_STR = r"'(?:[^'\\\n]|\\[\s\S])*'|\"(?:[^\"\\\n]|\\[\s\S])*\"|`(?:[^`\\]|\\[\s\S])*`"


class Script(Newlines):
    def other(self, text: str, c: str) -> int:
        if c == "/" and len(text) > 2:
            return self.REGEX
        if c == "#" and len(text) > 1:
            return self.grammar.term("PRIVATE")
        if len(text) > 1 and text[-1] in "\"'`" and c == text[-1]:
            return self.STR
        return self.ID if c.isalpha() or c in "_$" else self.ERR


def _make_script(ts: bool) -> Script:
    text = _script(ts).replace("KEYWORD", " | ".join(f"'{w}'" for w in _JS_HARD.split()))
    end = ") ] } ++ -- this super null true false return break continue debugger" + (" > void !" if ts else "")
    return Script(
        "typescript" if ts else "javascript", text, ["file"], _JS_HARD, r"[ \t\r\f\v ﻿]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/|\A#![^\n]*",
        rf"\n\s*|{_JS_REGEX}|{_JS_STR}|#?[^\W\d][\w$]*|\$[\w$]*|{_NUM}n?|{_JS_OPS}", enders=end, starters="++ -- ! ~ @ # PRIVATE", never="in of instanceof as else catch finally extends implements satisfies from",
    )


# ---------------------------------------------------------------- Python

_PY_HARD = "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield"
_PY = """
file = (NL | stmt)* ;
stmt = simple (';' simple)* ';'? NL | compound ;
suite = simple (';' simple)* ';'? NL | NL INDENT stmt+ DEDENT ;
simple = 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'global' ID (',' ID)* | 'nonlocal' ID (',' ID)* | 'del' exprs | 'assert' expr (',' expr)?
  | 'import' dotted ('as' ID)? (',' dotted ('as' ID)?)* | 'from' ('.' | '...')* dotted? 'import' ('*' | '(' names ','? ')' | names) | assignment | 'type' ID tparams? '=' expr ;
names = ID ('as' ID)? (',' ID ('as' ID)?)* ;
dotted = ID ('.' ID)* ;
assignment = exprs ( (':' expr ('=' rhs)?) | ('=' rhs)+ | augop rhs )? | 'yield' ('from' expr | exprs)? ;
rhs = exprs | 'yield' ('from' expr | exprs)? ;
augop = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '**=' | '>>=' | '<<=' | '&=' | '|=' | '^=' | '@=' ;
compound = 'if' named ':' suite ('elif' named ':' suite)* ('else' ':' suite)? | 'while' named ':' suite ('else' ':' suite)? | 'async'? 'for' exprs 'in' exprs ':' suite ('else' ':' suite)?
  | 'try' ':' suite ( ('except' '*'? (exprs ('as' ID)?)? ':' suite)+ ('else' ':' suite)? ('finally' ':' suite)? | 'finally' ':' suite )
  | 'async'? 'with' ( withs | '(' withs ','? ')' ) ':' suite | decorator* (fdef | 'class' ID tparams? ('(' arglist? ')')? ':' suite)
  | 'match' exprs ':' NL INDENT ('case' exprs ('as' ID)? ('if' named)? ':' suite)+ DEDENT ;
withs = expr ('as' postfix)? (',' expr ('as' postfix)?)* ;
decorator = '@' named NL ;
fdef = 'async'? 'def' ID tparams? '(' params? ')' ('->' expr)? ':' suite ;
tparams = '[' tparam (',' tparam)* ','? ']' ;
tparam = ('*' | '**')? ID (':' expr)? ('=' expr)? ;
params = param (',' param)* ','? ;
param = ID (':' star)? ('=' expr)? | '*' (ID (':' star)?)? | '**' ID (':' expr)? | '/' ;
exprs = star (',' star)* ','? ;
star = '*' expr | named ;
named = expr (':=' expr)? ;
expr = 'lambda' lparams? ':' expr | ortest ('if' ortest 'else' expr)? ;
lparams = lparam (',' lparam)* ','? ;
lparam = ID ('=' expr)? | '*' ID? | '**' ID | '/' ;
ortest = unary (bop unary)* ;
bop = 'and' | 'or' | 'in' | 'not' 'in' | 'is' 'not'? | '<' | '>' | '==' | '>=' | '<=' | '!=' | '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' | '**' ;
unary = ('not' | '+' | '-' | '~' | 'await')* postfix ;
postfix = atom ('.' ID | '(' arglist? ')' | '[' subs ']')* ;
subs = sub (',' sub)* ','? ;
sub = star | named? ':' expr? (':' expr?)? ;
arglist = arg (',' arg)* ','? ;
arg = '*' expr | '**' expr | ID '=' expr | named comp* ;
comp = 'async'? 'for' exprs 'in' ortest ('if' 'not'? ortest)* ;
atom = ID | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' (exprs | 'yield' ('from' expr | exprs)? | named comp+)? ')' | '[' (exprs | named comp+)? ']' | '{' (dictitems | exprs | named comp+)? '}' ;
dictitems = ditem (',' ditem)* ','? | expr ':' expr comp+ ;
ditem = expr ':' expr | '**' expr ;
"""


class Python(Language):
    _prefix = re.compile(r"(?i)^(?:[rbuft]{1,2})?[\"']")

    def other(self, text: str, c: str) -> int:
        if text[-1] in "\"'" and len(text) > 1 and self._prefix.match(text):
            return self.STR
        return self.ID if c.isalpha() or c == "_" else self.ERR

    def classes(self, text: str) -> list[int]:
        known, classify = self.known, self.classify
        t = self.grammar.term
        nl, indent, dedent, err = self.NL, t("INDENT"), t("DEDENT"), self.ERR
        opens, closes = {t(x) for x in "([{"}, {t(x) for x in ")]}"}
        out: list[int] = []
        add = out.append
        depth, levels, last = 0, [""], nl
        tokens = self.find(text)
        lead = re.match(r"(?:[ \t\f]*(?:#[^\n]*)?\r?\n)*([ \t]*)", text)
        if lead and lead[1] and lead.end() < len(text):
            return [err]
        for tok in tokens:
            c = known.get(tok)
            if c is None:
                if not tok:
                    break
                c = known[tok] = classify(tok)
            if c == nl:
                if depth or last == nl:
                    if depth:
                        continue
                else:
                    add(nl)
                    last = nl
                margin = tok.rsplit("\n", 1)[1]
                if "#" in margin:  # a comment ends the file
                    margin = ""
                top = levels[-1]
                if margin == top:
                    continue
                if margin.startswith(top):
                    levels.append(margin)
                    add(indent)
                else:
                    while len(levels) > 1 and levels[-1] != margin and levels[-1].startswith(margin):
                        levels.pop()
                        add(dedent)
                    if levels[-1] != margin:
                        add(err)
                continue
            add(c)
            last = c
            if c in opens:
                depth += 1
            elif c in closes:
                depth -= 1
        if last != nl:
            add(nl)
        out.extend([dedent] * (len(levels) - 1))
        return out


_PY_STR = r"(?i:[rbuft]{1,2})?(?:\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"


def _make_python() -> Python:
    # A newline token ends with the margin of the next line that has code.
    return Python(
        "python", _PY, ["file"], _PY_HARD, r"[ \t\f\r]+|#[^\n]*|\\\r?\n", rf"\n(?:[ \t\f\r]*(?:#[^\n]*)?\n)*(?:[ \t\f\r]*(?:#[^\n]*)?\Z|[ \t\f]*)|{_PY_STR}|{_ID}|{_NUM}[jJ]?(?!\w)|\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|@=|\*\*|//|<<|>>|[()\[\]{{}},:;.=+\-*/%&|^~<>@]",
    )


# ---------------------------------------------------------------- Go

_GO_HARD = "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var"
_GO = """
file = 'package' ID ';' (import ';')* (top ';')* ;
import = 'import' (ispec | '(' (ispec ';')* ispec? ')') ;
ispec = ('.' | ID)? STR ;
top = 'func' receiver? ID tparams? signature block? | decl ;
receiver = '(' (ID? type) ')' ;
decl = 'const' group | 'var' group | 'type' (tspec | '(' (tspec ';')* tspec? ')') ;
group = vspec | '(' (vspec ';')* vspec? ')' ;
vspec = ID (',' ID)* type? ('=' exprs)? ;
tspec = ID tparams? '='? type ;
tparams = '[' ID (',' ID)* constraint (',' ID (',' ID)* constraint)* ','? ']' ;
constraint = '~'? type ('|' '~'? type)* ;
signature = '(' params? ')' (type | '(' params? ')')? ;
params = param (',' param)* ','? ;
param = ID? '...'? type ;
type = ID ('.' ID)? ('[' type (',' type)* ']')? | '*' type | '[' (expr | '...')? ']' type | 'map' '[' type ']' type | '<-'? 'chan' '<-'? type | 'func' signature | '(' type ')'
  | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (imember ';')* imember? '}' ;
field = (ID (',' ID)* type | '*'? ID ('.' ID)? ('[' type ']')?) STR? ;
imember = ID signature | constraint ;
block = '{' stmts? '}' ;
stmts = (stmt? ';')+ stmt? | stmt ;
stmt = decl | simple | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | block | if | 'for' forhead? block | switch | 'select' '{' (('case' simple | 'default') ':' stmts?)* '}' | 'go' expr | 'defer' expr | ID ':' stmt? ;
if = 'if' (simple? ';')? expr block ('else' (if | block))? ;
forhead = expr | simple? ';' expr? ';' simple? | (exprs ('=' | ':='))? 'range' expr ;
switch = 'switch' (simple? ';')? simple? '{' (('case' cases | 'default') ':' stmts?)* '}' ;
cases = (expr | type) (',' (expr | type))* ;
simple = exprs ( ('=' | ':=' | aop) exprs | '++' | '--' | '<-' expr )? ;
aop = '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
exprs = expr (',' expr)* ;
expr = unary (bop unary)* ;
bop = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-')* primary suffix* ;
primary = ID | NUM | STR | CHAR | '(' (expr | type) ')' | 'func' signature block | ltype literal | convtype '(' expr ','? ')' ;
ltype = '[' (expr | '...')? ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}' ;
convtype = '[' ']' type | 'map' '[' type ']' type | 'chan' type | 'interface' '{' '}' | 'struct' '{' '}' ;
suffix = '.' (ID | '(' (type | 'type') ')') | '[' (expr | expr? ':' expr? (':' expr)? | type (',' type)*) ']' | '(' (arg (',' arg)* '...'? ','?)? ')' | literal ;
arg = expr | type ;
literal = '{' (elem (',' elem)* ','? ';'?)? '}' ;
elem = (expr | literal) (':' (expr | literal))? ;
"""


def _make_go() -> Newlines:
    return Newlines(
        "go", _GO, ["file"], _GO_HARD, r"[ \t\r﻿]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/",
        rf"\n\s*|\"(?:[^\"\\\n]|\\.)*\"|`[^`]*`|'(?:[^'\\\n]|\\[^\n]+?)'|{_ID}|{_NUM}i?|<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[()\[\]{{}},:;.=+\-*/%&|^~<>!]",
        enders=") ] } ++ -- return break continue fallthrough", emit=";",
    )


# ---------------------------------------------------------------- Java

_JAVA_HARD = "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null"
_JAVA = """
file = (anns? 'package' qname ';')? (import | ';')* (typedecl | ';')* ;
import = 'import' 'static'? qname ('.' '*')? ';' ;
qname = ID ('.' ID)* ;
anns = ann+ ;
ann = '@' qname ('(' (annarg (',' annarg)*)? ')')? ;
annarg = (ID '=')? annvalue ;
annvalue = expr | ann | '{' (annvalue (',' annvalue)*)? ','? '}' ;
mods = (ann | 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | 'sealed' | 'non' '-' 'sealed')+ ;
typedecl = mods? ( 'class' ID tparams? ('extends' type)? ('implements' types)? ('permits' types)? body | 'interface' ID tparams? ('extends' types)? ('permits' types)? body
  | 'enum' ID ('implements' types)? '{' (econst (',' econst)* ','?)? (';' member*)? '}' | 'record' ID tparams? '(' params? ')' ('implements' types)? body | '@' 'interface' ID body ) ;
econst = anns? ID args? body? ;
body = '{' member* '}' ;
member = ';' | 'static'? block | typedecl | mods? tparams? ( type ID '(' params? ')' dims? throws? (block | ('default' annvalue)? ';') | 'void' ID '(' params? ')' throws? (block | ';') | ID '(' params? ')' throws? block | ID block | type vars ';' ) ;
throws = 'throws' types ;
types = type (',' type)* ;
tparams = '<' tparam (',' tparam)* '>' ;
tparam = anns? ID ('extends' type ('&' type)*)? ;
targs = '<' (targ (',' targ)*)? '>' ;
targ = type | anns? '?' (('extends' | 'super') type)? ;
type = anns? (prim | ID targs? ('.' ID targs?)*) dims? ;
prim = 'boolean' | 'byte' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' ;
dims = ('[' ']')+ ;
params = param (',' param)* ;
param = mods? type '...'? (ID | 'this') dims? ;
vars = var (',' var)* ;
var = ID dims? ('=' init)? ;
init = expr | '{' (init (',' init)* ','?)? '}' ;
block = '{' stmt* '}' ;
stmt = block | ';' | mods? type vars ';' | typedecl | expr ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | for | 'return' expr? ';' | 'break' ID? ';' | 'continue' ID? ';' | 'throw' expr ';'
  | 'synchronized' '(' expr ')' block | 'assert' expr (':' expr)? ';' | 'yield' expr ';' | switch | try | ID ':' stmt ;
for = 'for' '(' ( (mods? type vars | exprs)? ';' expr? ';' exprs? | mods? type ID ':' expr ) ')' stmt ;
exprs = expr (',' expr)* ;
switch = 'switch' '(' expr ')' '{' (label stmt* | arrowcase)* '}' ;
label = ('case' caseval (',' caseval)* | 'default') ':' ;
arrowcase = ('case' caseval (',' caseval)* | 'default') '->' (expr ';' | block | 'throw' expr ';') ;
caseval = (expr | type ID | 'default') ('when' expr)? ;
try = 'try' ('(' resource (';' resource)* ';'? ')')? block ('catch' '(' mods? type ('|' type)* ID ')' block)* ('finally' block)? ;
resource = mods? type ID '=' expr | expr ;
expr = lambda | binary ('?' expr ':' expr)? (aop expr)? ;
lambda = (ID | '(' (ID (',' ID)*)? ')' | '(' params? ')') '->' (expr | block) ;
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' | '>' '>' '>' '=' ;
binary = unary (bop unary | 'instanceof' ('final'? type ID? | pat))* ;
pat = type '(' (patarg (',' patarg)*)? ')' ;
patarg = type ID | pat ;
bop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>' ('>' '>'?)? '='? | '<<' | '&' | '|' | '^' | '&&' | '||' ;
unary = ('+' | '-' | '!' | '~' | '++' | '--' | '(' type ('&' type)* ')')* postfix ;
postfix = primary suffix* ('++' | '--')* ;
suffix = '.' (targs? ID | 'this' | 'class' | 'super' | 'new' ID targs? args body?) | '[' expr ']' | args | '::' (ID | 'new') ;
args = '(' (expr (',' expr)*)? ')' ;
primary = ID | NUM | STR | CHAR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | (prim | 'void') dims? ('.' 'class' | '::' 'new') | type '::' (ID | 'new') | ID dims '.' 'class' | 'new' anns? (ID targs? ('.' ID targs?)* | prim) ( args body? | ('[' expr ']')+ dims? | dims '{' (init (',' init)* ','?)? '}' ) | switch ;
"""


def _make_java() -> Language:
    return Language(
        "java", _JAVA, ["file"], _JAVA_HARD, r"[ \t\r\n\f﻿]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/",
        rf"\"\"\"(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\[^\n']+|\\')'|[^\W\d][\w$]*|{_NUM}[lLfFdD]?|<<=|\.\.\.|->|::|&&|\|\||\+\+|--|==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>|[()\[\]{{}},:;.=+\-*/%&|^~<!?@]",
    )


# ---------------------------------------------------------------- Rust

_RUST_HARD = "as break const continue crate else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while async await dyn"
_RUST = """
file = inner* item* ;
inner = '#' '!' '[' tree* ']' ;
attr = '#' '[' tree* ']' ;
tree = TT | '(' tree* ')' | '[' tree* ']' | '{' tree* '}' ;
item = attr* vis? ( fn | struct | enum | 'union' ID generics? fields | impl | trait | 'use' usetree ';' | 'extern' 'crate' ID ('as' ID)? ';' | 'mod' ID (';' | '{' inner* item* '}') | const | 'static' 'mut'? ID ':' type '=' expr ';' | 'type' ID generics? (':' bounds)? where? ('=' type)? where? ';' | 'unsafe'? 'extern' STR? '{' item* '}' | macro ) ;
vis = 'pub' ('(' ('in'? path) ')')? ;
const = 'const' (ID | '_') ':' type ('=' expr)? ';' ;
fn = ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' ID generics? '(' params? ')' ('->' type)? where? (block | ';') ;
params = param (',' param)* ','? ;
param = attr* ( '&'? LIFE? 'mut'? 'self' (':' type)? | pattern ':' type | '...' ) ;
generics = '<' (gparam (',' gparam)* ','?)? '>' ;
gparam = attr* ( LIFE (':' LIFE ('+' LIFE)*)? | ID (':' bounds?)? ('=' type)? | 'const' ID ':' type ('=' expr)? ) ;
bounds = bound ('+' bound)* '+'? ;
bound = LIFE | '?'? ('for' generics)? path | '(' '?'? path ')' ;
where = 'where' (wpred (',' wpred)* ','?)? ;
wpred = (LIFE | ('for' generics)? type) ':' bounds? ;
struct = 'struct' ID generics? ( where? fields | '(' (tfield (',' tfield)* ','?)? ')' where? ';' | ';' ) ;
fields = '{' (field (',' field)* ','?)? '}' ;
field = attr* vis? ID ':' type ;
tfield = attr* vis? type ;
enum = 'enum' ID generics? where? '{' (variant (',' variant)* ','?)? '}' ;
variant = attr* vis? ID (fields | '(' (tfield (',' tfield)* ','?)? ')')? ('=' expr)? ;
impl = 'unsafe'? 'impl' generics? '!'? type ('for' type)? where? '{' inner* item* '}' ;
trait = 'unsafe'? 'trait' ID generics? (':' bounds?)? where? '{' item* '}' ;
usetree = '::'? seg ('::' seg)* ('::' ('*' | uselist) | 'as' (ID | '_'))? | '::'? uselist | '*' ;
uselist = '{' (usetree (',' usetree)* ','?)? '}' ;
seg = ID | 'self' | 'super' | 'crate' | 'Self' ;
path = '::'? pseg ('::' pseg)* ;
pseg = seg ( '::'? targs | '(' (type (',' type)* ','?)? ')' ('->' type)? )? ;
targs = '<' (targ (',' targ)* ','?)? '>' ;
targ = LIFE | type | ID '=' type | ID ':' bounds | '-'? NUM | block | 'true' | 'false' ;
type = path | '(' (type (',' type)* ','?)? ')' | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '[' type (';' expr)? ']' | ('for' generics)? 'unsafe'? ('extern' STR?)? 'fn' '(' (ftype (',' ftype)* ','?)? ')' ('->' type)? | ('dyn' | 'impl') bounds | '!' | '_' | '<' type ('as' path)? '>' ('::' pseg)+ | path '!' ('(' tree* ')' | '[' tree* ']') ;
ftype = (ID ':')? type ;
block = '{' inner* stmts? '}' ;
stmts = stmt+ expr? | expr ;
stmt = ';' | item | 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | attr* expr ';' | attr* blockexpr ;
blockexpr = (LIFE ':')? ( ('unsafe' | 'async' 'move'? | 'const')? block | if | 'loop' block | 'while' cond block | 'for' pattern 'in' expr block ) | match | macro ;
macro = path '!' ID? ( '{' tree* '}' | ('(' tree* ')' | '[' tree* ']') ';' ) ;
if = 'if' cond block ('else' (if | block))? ;
cond = expr | 'let' pattern '=' expr (('&&' | '||') ('let' pattern '=')? expr)* ;
match = 'match' expr '{' inner* (arm)* '}' ;
arm = attr* '|'? pattern ('if' cond)? '=>' (expr ',' | expr | blockexpr ','?) ;
pattern = patone ('|' patone)* ;
patone = 'ref'? 'mut'? ID ('@' patone)? | '_' | '..' | lit (('..' | '..=') lit?)? | '..=' lit | '&' 'mut'? patone | '&&' 'mut'? patone | '(' (pattern (',' pattern)* ','?)? ')' | '[' (pattern (',' pattern)* ','?)? ']' | path (('(' (pattern (',' pattern)* ','?)? ')') | '{' (fpat (',' fpat)* ','?)? '}' | ('..' | '..=') lit)? | path '!' '(' tree* ')' ;
fpat = attr* ( '..' | (ID | NUM) ':' pattern | 'ref'? 'mut'? ID ) ;
lit = '-'? NUM | STR | CHAR | 'true' | 'false' | path ;
expr = 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | closure | range ;
closure = 'move'? ('|' (cparam (',' cparam)* ','?)? '|' | '||') ( expr | '->' type block ) ;
cparam = pattern (':' type)? ;
range = ('..' | '..=') binary? | binary (('..' | '..=') binary?)? (aop expr)? ;
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>' '=' ;
binary = unary (bop (unary | closure) | 'as' type)* ;
bop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>' '>'? '='? | '<<' | '&' | '|' | '^' | '&&' | '||' ;
unary = ('-' | '!' | '*' | '&' 'mut'? | '&&' 'mut'?)* primary suffix* ;
suffix = '.' (ID ('::' targs)? | NUM | 'await') | '(' (expr (',' expr)* ','?)? ')' | '[' expr ']' | '?' ;
primary = NUM | STR | CHAR | 'true' | 'false' | path | path '{' (finit (',' finit)* ','?)? '}' | path '!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}') | '(' (expr (',' expr)* ','?)? ')' | '[' (expr (';' expr | (',' expr)* ','?))? ']' | '<' type ('as' path)? '>' ('::' pseg)+
  | (LIFE ':')? ( ('unsafe' | 'async' 'move'? | 'const')? block | if | 'loop' block | 'while' cond block | 'for' pattern 'in' expr block ) | match ;
finit = attr* ( (ID | NUM) (':' expr)? | '..' expr? ) ;
"""


class Rust(Language):
    def other(self, text: str, c: str) -> int:
        if c == "'" and not (len(text) > 1 and text[-1] == "'"):
            return self.grammar.term("LIFE") if len(text) > 1 else self.ERR
        if text[-1] in "\"#" and len(text) > 1 and (c in '"rbc'):
            return self.STR
        if text[-1] == "'" and len(text) > 2:
            return self.CHAR
        return self.ID if c.isalpha() or c == "_" else self.ERR


def _make_rust() -> Rust:
    ops = "+ - * / % = == != < <= > & && | || ^ ! ? . .. ..= ... , ; : :: -> => # @ ~ $ << += -= *= /= %= &= |= ^= <<= _".split()
    tokens = " | ".join(["ID", "NUM", "STR", "CHAR", "LIFE", *(f"'{o}'" for o in ops), *(f"'{w}'" for w in _RUST_HARD.split())])
    grammar = re.sub(r"\bTT\b", f"({tokens})", _RUST)
    return Rust(
        "rust", grammar, ["file"], _RUST_HARD + " _", r"[ \t\r\n﻿]+|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/",
        rf"[bc]?r\"[^\"]*\"|[bc]?r#\"(?:[^\"]|\"(?!#))*\"#|[bc]?r##\"(?:[^\"]|\"(?!##))*\"##|[bc]?\"(?:[^\"\\]|\\[\s\S])*\"|b?'(?:[^'\\\n]|\\[^\n']+|\\')'|'[^\W\d]\w*|(?:r#)?{_ID}|\d[\d_]*(?=\.\.|\.[^\W\d])|{_NUM}(?:[iuf]\d+|[iu]size)?|<<=|\.\.=|\.\.\.|\.\.|->|=>|::|&&|\|\||==|!=|<=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>|[()\[\]{{}},:;.=+\-*/%&|^~<!?@#$]",
    )


# ---------------------------------------------------------------- C

_C_HARD = "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Bool"
_C = """
file = ext* ;
ext = ';' | 'extern' STR ('{' ext* '}' | ext) | specs ( declr block | declr decl_kr block | (idecl (',' idecl)*)? ';' ) | ID '(' args? ')' ';'? | asm ';' | sassert ;
sassert = ('_Static_assert' | 'static_assert') '(' expr (',' STR)? ')' ';' ;
decl_kr = (specs idecl (',' idecl)* ';')+ ;
specs = spec+ ;
spec = 'typedef' | 'extern' | 'static' | 'auto' | 'register' | 'inline' | 'const' | 'volatile' | 'restrict' | '_Noreturn' | '_Atomic' | '_Thread_local' | attribute | 'void' | 'char' | 'short' | 'int' | 'long' | 'float' | 'double' | 'signed' | 'unsigned' | '_Bool' | ID | ('struct' | 'union') attribute? (ID? '{' sdecl* '}' | ID) | 'enum' (ID? '{' enumr (',' enumr)* ','? '}' | ID) | 'typeof' '(' (expr | tname) ')' ;
attribute = ('__attribute__' | '__attribute' | '__declspec') '(' attrtree* ')' ;
attrtree = ID | NUM | STR | ',' | '=' | 'const' | '(' attrtree* ')' ;
sdecl = specs (sdeclr (',' sdeclr)*)? ';' | ';' | sassert ;
sdeclr = declr? ':' expr | declr attribute? ;
enumr = ID attribute? ('=' assign)? ;
idecl = declr (asm)? attribute* ('=' init)? ;
declr = ptr? direct ;
ptr = ('*' | 'const' | 'volatile' | 'restrict' | '_Nonnull')+ ;
direct = (ID | '(' attribute? declr ')') dsuffix* ;
dsuffix = '[' ('static' | 'const' | 'restrict')* (assign | '*')? ']' | '(' params? ')' attribute* ;
params = param (',' param)* (',' '...')? | ID (',' ID)* | '...' ;
param = specs (declr | adeclr)? attribute* ;
adeclr = ptr adirect? | adirect ;
adirect = ('(' adeclr ')' | asuffix) asuffix* ;
asuffix = '[' ('static' | 'const')* (assign | '*')? ']' | '(' params? ')' ;
tname = specs adeclr? ;
init = assign | '{' (initem (',' initem)* ','?)? '}' ;
initem = (('.' ID | '[' assign ('...' assign)? ']')+ '=')? init | ID ':' init ;
block = '{' bitem* '}' ;
bitem = specs (idecl (',' idecl)*)? ';' | stmt | sassert ;
stmt = block | expr? ';' | 'if' '(' expr ')' stmt ('else' stmt)? | 'switch' '(' expr ')' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (expr? ';' | specs idecl (',' idecl)* ';') expr? ';' expr? ')' stmt | 'goto' '*'? expr ';' | 'continue' ';' | 'break' ';' | 'return' expr? ';' | ID ':' attribute? (stmt | specs idecl ';')? | 'case' assign ('...' assign)? ':' (stmt | specs idecl ';')? | 'default' ':' stmt? | asm ';' ;
asm = ('asm' | '__asm__' | '__asm') ('volatile' | '__volatile__' | 'goto')* '(' asmtree* ')' ;
asmtree = STR | ':' | ',' | expr | '[' ID ']' ;
args = arg (',' arg)* ;
arg = assign | tname ;
expr = assign (',' assign)* ;
assign = binary ('?' expr? ':' assign)? (aop assign)? ;
aop = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' ;
binary = unary (bop unary)* ;
bop = '+' | '-' | '*' | '/' | '%' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '<<' | '>>' | '&' | '|' | '^' | '&&' | '||' ;
unary = ('+' | '-' | '!' | '~' | '*' | '&' | '&&' | '++' | '--' | 'sizeof' | '__extension__' | '(' tname ')')* postfix ;
postfix = primary ('.' ID | '->' ID | '[' expr ']' | '(' args? ')' | '++' | '--')* ;
primary = ID | NUM | (STR | ID STR)+ ID? | CHAR | '(' expr ')' | '(' block ')' | 'sizeof' '(' tname ')' | '(' tname ')' '{' (initem (',' initem)* ','?)? '}' | '_Generic' '(' assign (',' (tname | 'default') ':' assign)+ ')' | ('__builtin_offsetof' | 'offsetof' | '_Alignof' | 'alignof') '(' tname (',' expr)? ')' ;
"""


class C(Language):
    def other(self, text: str, c: str) -> int:
        if len(text) > 1 and text[-1] == '"':
            return self.STR
        if len(text) > 2 and text[-1] == "'":
            return self.CHAR
        return self.ID if c.isalpha() or c in "_$" else self.ERR


def _make_c() -> C:
    directive = r"(?m:^)[ \t]*#[ \t]*(?:(?:include(?:_next)?|define|undef|if|ifdef|ifndef|elif|elifdef|else|endif|error|warning|pragma|line|ident|import)\b(?:[^\\\n/]|\\\r?\n|\\.|/(?!\*)|/\*(?:[^*]|\*(?!/))*\*/)*|(?=\r?\n))"
    return C(
        "c", _C, ["file"], _C_HARD, rf"{directive}|[ \t\r\n\f\v﻿]+|\\\r?\n|//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/",
        rf"(?:u8|[uUL])?\"(?:[^\"\\\n]|\\[\s\S])*\"|[uUL]?'(?:[^'\\\n]|\\[^\n']+|\\')+'|[^\W\d][\w$]*|(?:0[xX][0-9a-fA-F.]+(?:[pP][+-]?\d+)?|{_NUM})[uUlLfF]*|<<=|>>=|\.\.\.|->|&&|\|\||\+\+|--|==|!=|<=|>=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[()\[\]{{}},:;.=+\-*/%&|^~<>!?]",
    )


# ---------------------------------------------------------------- Ruby

_RUBY_HARD = "BEGIN END alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield"
_RUBY = """
file = seq? ;
seq = sep* expr_stmt (sep+ expr_stmt)* sep* | sep+ ;
sep = NL | ';' ;
expr_stmt = stmt (('if' | 'unless' | 'while' | 'until' | 'rescue') stmt)* ;
stmt = notexpr (('and' | 'or') NL? notexpr)* | 'alias' fname fname | 'undef' fname (',' fname)* | 'BEGIN' '{' seq? '}' | 'END' '{' seq? '}' ;
notexpr = 'not'? (command | expr | multi) ;
multi = mlhs '=' NL? mrhs ;
mlhs = mitem (',' mitem)+ ','? | mitem ',' ;
mitem = '*'? postfix | '*' | '(' mlhs ')' ;
mrhs = marg (',' marg)* | command ;
marg = '*'? expr ;
command = (postfix '.' callname | postfix '&.' callname | ID | CONST | METHOD | 'yield' | 'super' | 'return' | 'break' | 'next') cargs doblock? | postfix aop NL? (command | mrhs) | ('return' | 'break' | 'next') command | '!' command ;
cargs = carg (',' NL? carg)* (',' command)? ;
carg = '*' expr | '**' expr | '&' expr | LABEL NL? expr? | STR ':' expr | expr ('=>' NL? expr)? | '*' | '&' ;
aop = '=' | OPASGN ;
expr = binary ('?' NL? expr ':' NL? expr | '?' LABEL NL? expr)? (aop NL? (expr 'rescue' expr | expr))? ;
binary = unary (bop NL? unary)* ('..' | '...')? ;
bop = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '=~' | '!~' | '<=>' | '<' | '<=' | '>' | '>=' | '<<' | '>>' | '&' | '|' | '^' | '&&' | '||' | '..' | '...' ;
unary = ('!' | '-' | '+' | '~' | '&' | 'defined?' | '..' | '...')* postfix ;
postfix = primary suffix* ;
suffix = ('.' | '&.') (callname pargs? | pargs) block? | '::' callname pargs? block? | '[' (arglist NL?)? ']' | pargs block? | block ;
callname = ID | CONST | METHOD | 'class' | 'then' | 'end' | 'begin' | 'self' | 'in' | 'if' | 'not' | 'next' | 'nil' | 'self' | 'for' | 'when' | 'case' | 'do' | 'or' | 'and' ;
pargs = '(' NL? (arglist NL?)? ')' ;
arglist = NL? carg (NL? ',' NL? carg)* (NL? ',')? | NL? command ;
block = '{' bparams? seq? '}' | doblock ;
doblock = 'do' bparams? bodystmt? 'end' ;
bparams = '|' (bparam (',' bparam)* ','?)? (';' ID (',' ID)*)? '|' | '||' ;
bparam = ('*' | '**' | '&')? ID ('=' unary)? | LABEL unary? | '(' bparam (',' bparam)* ')' | '*' | '**' ;
bodystmt = seq rescues? | rescues ;
rescues = ('rescue' (marg (',' marg)*)? ('=>' postfix)? 'then'? seq?)+ ('else' seq?)? ('ensure' seq?)? | 'ensure' seq? ;
primary = ID | CONST | METHOD | IVAR | NUM | STR+ | CHAR | REGEX | SYMBOL | WORDS | 'self' | 'nil' | 'true' | 'false' | '::' CONST | '(' seq? ')' | '[' (arglist NL?)? ']' | '{' NL? (hitem (NL? ',' NL? hitem)* ','? NL?)? '}' | '->' (lparams | pargs_decl)? ('{' seq? '}' | 'do' bodystmt? 'end')
  | 'if' stmt then seq? ('elsif' stmt then seq?)* ('else' seq?)? 'end' | 'unless' stmt then seq? ('else' seq?)? 'end' | ('while' | 'until') stmt ('do' | sep) seq? 'end' | 'for' mlhs_or 'in' expr ('do' | sep) seq? 'end'
  | 'case' stmt? sep+ ( ('when' warg (',' NL? warg)* then seq?)+ | ('in' pat ('if' stmt)? then seq?)+ ) ('else' seq?)? 'end' | 'begin' bodystmt? 'end' | 'class' ('<<' expr | cpath ('<' expr)?) sep bodystmt? 'end' | 'module' cpath sep bodystmt? 'end' | 'class' cpath 'end' | 'module' cpath 'end' | def | 'yield' pargs? | 'super' pargs? | 'return' | 'break' | 'next' | 'redo' | 'retry' ;
pat = expr (',' expr)* | hitem (',' hitem)* ;
mlhs_or = mitem (',' mitem)* ;
warg = '*'? expr ;
then = sep+ 'then'? | 'then' ;
hitem = LABEL NL? expr? | STR ':' NL? expr | '**' expr | expr '=>' NL? expr ;
cpath = '::'? CONST ('::' CONST)* ;
lparams = lparam (',' lparam)* ;
lparam = ('*' | '**' | '&')? ID ('=' unary)? | LABEL unary? ;
pargs_decl = '(' NL? (dparam (NL? ',' NL? dparam)* NL?)? ')' ;
dparam = ('*' | '**' | '&')? ID ('=' expr)? | LABEL expr? | '(' dparam (',' dparam)* ')' | '*' | '**' | '&' | '...' ;
fname = ID | CONST | METHOD | SYMBOL | OPNAME | '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '=~' | '<=>' | '<' | '<=' | '>' | '>=' | '<<' | '>>' | '&' | '|' | '^' | '!' | '~' | '[' ']' '='? | 'class' | 'end' | 'if' ;
def = ('private' | 'public' | 'protected' | 'module_function')? 'def' (('self' | ID | CONST | IVAR) '.')? fname '='? ( pargs_decl sep? | (dparam (',' NL? dparam)*)? sep ) bodystmt? 'end' | 'def' (('self' | ID | CONST) '.')? fname pargs_decl? '=' NL? (expr | command) ;
"""


class Ruby(Newlines):
    def other(self, text: str, c: str) -> int:
        t = self.grammar.term
        if c == ":" and len(text) > 1:
            return t("SYMBOL")
        if c == "%" and len(text) > 2:
            return t("WORDS")
        if c == "/" and len(text) > 1:
            return self.REGEX
        if c in "@$" and len(text) > 1:
            return t("IVAR")
        if text[-1] == ":" and len(text) > 1:
            return t("LABEL")
        if text[-1] in "?!" and len(text) > 1 and (c.isalpha() or c == "_"):
            return t("METHOD")
        if len(text) > 1 and text[-1] == c and c in "\"'`":
            return self.STR
        if c.isalpha() or c == "_":
            return t("CONST") if c.isupper() else self.ID
        return t("OPASGN") if text[-1] == "=" and len(text) > 1 else self.ERR

    _heredoc = re.compile(r"<<(?:[~-]([\"'`]?)|([\"'`]?)(?=[A-Z_]))([A-Za-z_]\w*)(?:\1|\2)([^\n]*\n)(?:[\s\S]*?\n)?[ \t]*\3[ \t]*\r?(?=\n|\Z)")

    def classes(self, text: str) -> list[int]:
        if "<<" in text:
            text = self._heredoc.sub(r'"" \4', text)
        return super().classes(text)

    def classify(self, text: str) -> int:
        if text[0].isupper() and text not in ("BEGIN", "END"):
            return self.grammar.term("LABEL" if text[-1] == ":" else "METHOD" if text[-1] in "?!" else "CONST")
        return super().classify(text)


def _make_ruby() -> Ruby:
    regex = r"(?:(?<=[=(,\[!&|?{};\n~])|(?<=[=(,\[!&|?{};~] )|(?<=when )|(?<=if )|(?<=unless )|(?<=and )|(?<=or )|(?<=return )|(?<=match )|(?<=split ))/(?![= ])(?:\\[^\n]|[^/\\\n])*/[a-z]*"
    return Ruby(
        "ruby", _RUBY, ["file"], _RUBY_HARD, r"[ \t\r﻿]+|\\\r?\n|(?m:^)=begin\b[\s\S]*?\n=end[^\n]*|#[^\n]*|(?m:^)__END__\r?\n[\s\S]*",
        rf"\n\s*|{regex}|%[wWiIqQ]?(?:\[[^\]]*\]|\([^)]*\)|\{{[^}}]*\}}|<[^>]*>|\|[^|]*\|)|\"(?:[^\"\\]|\\[\s\S])*\"(?=:[^:])|'(?:[^'\\]|\\[\s\S])*'|\"(?:[^\"\\]|\\[\s\S])*\"|`(?:[^`\\]|\\[\s\S])*`|[@$]{{1,2}}\w+|\$[!@&~0-9?:;,./\\<>_]|:(?:{_ID}[?!=]?(?![=~>])|\"(?:[^\"\\]|\\.)*\"|[+\-*/<>=!~%&|^]+|\[\]=?)|{_ID}[?!](?![=~])|defined\?|{_ID}:(?!:)|{_ID}|{_NUM}(?:r|i)?|\?\w(?!\w)|\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|->|=>|==|!=|=~|!~|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|\.\.|&\.|::|[()\[\]{{}},:;.=+\-*/%&|^~<>!?]",
        enders=") ] } end self nil true false return break next redo retry then do else begin ensure yield super rescue | || CONST METHOD IVAR SYMBOL WORDS LABEL * class", never=". &.", emit="NL",
    )


_MAKERS = {
    "json": lambda: JSON, "js": lambda: _make_script(False), "ts": lambda: _make_script(True), "py": _make_python, "go": _make_go, "java": _make_java, "rs": _make_rust, "c": _make_c, "rb": _make_ruby,
}
LANGUAGE_OF = {"json": "json", "js": "js", "mjs": "js", "cjs": "js", "ts": "ts", "mts": "ts", "cts": "ts", "py": "py", "go": "go", "java": "java", "rs": "rs", "c": "c", "h": "c", "rb": "rb"}
NAMES = {"json": "json", "js": "javascript", "ts": "typescript", "py": "python", "go": "go", "java": "java", "rs": "rust", "c": "c", "rb": "ruby"}
_MADE: dict[str, Language] = {}


def language(suffix: str) -> Language | None:
    """The language of a file suffix, built once per process."""
    key = LANGUAGE_OF.get(suffix)
    if key is None:
        return None
    if key not in _MADE:
        _MADE[key] = _MAKERS[key]()
    return _MADE[key]
