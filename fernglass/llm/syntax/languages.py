"""Lexers and grammars of Go, JavaScript, TypeScript, Java and Python.

A lexer turns a text into one character per token. Words that mean the same to the grammar share a character: plain
binary operators are "o", prefix ones "!", signs "-", assignments with an operator "~", steps "p".
"""

from __future__ import annotations

import re

#: Characters for token kinds; words of a language get further ones from WORDS upwards.
KINDS = {"ID": "i", "NUM": "n", "STR": "s", "BAD": "E"}
WORDS = 0x400
#: Groups get characters from here upwards.
GROUPS = 0xF0000

_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*[pP][+-]?\d+|0[xX][0-9a-fA-F_]+(?:[eE][+-]\d+)?|0[bB][01_]+|0[oO]?[0-7_]+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?)(?:[nLlfFdDjJi]|[uU][lL]?)?")
_TOKEN = {
    "go": r'//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*|`[^`]*`|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n]+?)\'',
    "js": r'//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*|`(?:[^`\\]|\\[\s\S])*`|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\'|(?:(?<=[=(,:;!&|?{}\[])|(?<=[=(,:;!&|?{}\[] )|(?<=return ))/(?![*/])(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*',
    "java": r'//[^\n]*|/\*[\s\S]*?\*/|/\*[\s\S]*|"""[\s\S]*?"""|"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\[^\n]+?)\'',
    "py": r'#[^\n]*|\\\r?\n|(?:[rRbBuUfF]{0,2})(?:"""(?:[^\\]|\\[\s\S])*?"""|\'\'\'(?:[^\\]|\\[\s\S])*?\'\'\'|"(?:[^"\\\n]|\\[\s\S])*"|\'(?:[^\'\\\n]|\\[\s\S])*\')',
}
_OPERATORS = r">>>=|===|!==|\*\*=|<<=|>>=|&&=|\|\|=|\?\?=|&\^=|\.\.\.|:=|=>|->|\+\+|--|<-|\+=|-=|\*=|/=|%=|&=|\|=|\^=|//=|@=|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\*\*|//|<<|&\^|::"
_REST = rf"[^\W\d][\w$]*|[$#]?[A-Za-z_$][\w$]*|\.?\d[\w.]*(?:(?<=[eEpP])[+-]\d+)?|{_OPERATORS}|\n|[^\S\n]+|[\s\S]"
LEXER = {k: re.compile(f"{v}|{_REST}") for k, v in _TOKEN.items()}
LEXER["ts"] = LEXER["js"]

RESERVED = {
    "go": "package import func return if else for range var const type struct interface map chan go defer switch case default break continue fallthrough goto select",
    "js": "import export from as default function return if else for of in const let var class extends new async await try catch finally throw this super typeof void delete while do switch case break continue instanceof yield null true false static get set debugger",
    "ts": "import export from as default function return if else for of in const let var class extends new async await try catch finally throw this super typeof void delete while do switch case break continue instanceof yield null true false static get set debugger interface type enum implements readonly public private protected abstract declare namespace keyof is satisfies",
    "java": "package import class interface enum extends implements public private protected static final abstract native synchronized transient volatile strictfp default void return if else for while do try catch finally throw throws new this super instanceof switch case break continue assert null true false boolean byte short int long float double char @record @permits @when",
    "py": "and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield None True False @match @case @type",
}
#: Words that stand for one thing in the grammar: value of a constant, prefix operator, modifier, primitive type.
MERGED = {
    "go": {},
    "js": {"null": "ID", "true": "ID", "false": "ID", "this": "ID", "super": "ID", "typeof": "!", "void": "!", "delete": "!", "await": "!", "new": "!", "instanceof": "o"},
    "java": {"null": "ID", "true": "ID", "false": "ID", **dict.fromkeys("boolean byte short int long float double char".split(), "prim"), **dict.fromkeys("public private protected final abstract native transient volatile strictfp".split(), "mod")},
    "py": {"None": "NUM", "True": "NUM", "False": "NUM", "and": "o", "or": "o", "await": "!"},
}
MERGED["ts"] = {**MERGED["js"], **dict.fromkeys("public private protected readonly abstract declare".split(), "mod")}
_SYMBOLS = {
    **dict.fromkeys("== != === !== <= >= && || ?? << >> >>> & | ^ &^ % / instanceof".split(), "o"),
    **dict.fromkeys("+= -= *= /= %= &= |= ^= <<= >>= >>>= **= &&= ||= ??= &^= //= @=".split(), "~"),
    **dict.fromkeys("+ -".split(), "-"), **dict.fromkeys("! ~".split(), "!"), **dict.fromkeys("++ --".split(), "p"), "?.": ".", "**": "*",
    **{c: c for c in "*<>=?:,;.()[]{}@"}, **{":=": "D", "=>": "A", "->": "R", "...": "V", "<-": "C", "::": "M", "\n": "\n"},
}
_SYMBOLS_OF = {"go": {"&": "*", "^": "-"}, "py": {"::": "::", "//": "o", "!": "E", "&&": "E", "||": "E", "===": "E", "!==": "E", "++": "--", ";": ";", ":=": "D", "*": "*", "**": "W", "~": "!", "?": "E"}, "java": {"&": "o"}, "js": {}, "ts": {}}


class Tokens(dict):
    """Token text to character; a miss is classified and kept, long literals are not."""

    def __init__(self, language: str):
        super().__init__()
        self.language = language
        self.words: dict[str, str] = {}
        code = WORDS
        for w in RESERVED[language].split():
            merged = MERGED[language].get(w, w)
            if merged in KINDS or merged in ("o", "!"):
                self.words[w] = KINDS.get(merged, merged)
            else:
                if merged not in self.words:
                    self.words[merged] = chr(code)
                    code += 1
                self.words[w] = self.words[merged]
        self.chars = {**KINDS, **{w: c for w, c in self.words.items() if ord(c) >= WORDS}, **{c: c for c in "o~-!p*<>=?:,;.@DARVCMWn"}, "N": "\n"}

    def __missing__(self, t: str) -> str:
        c = self.classify(t)
        if len(t) < 40 and len(self) < 200_000:
            self[t] = c
        return c

    def classify(self, t: str) -> str:
        if t in self.words:
            return self.words[t]
        own = _SYMBOLS_OF[self.language]
        if t in own:
            return own[t]
        if t in _SYMBOLS:
            return _SYMBOLS[t]
        first = t[0]
        lang = self.language
        if lang == "py":
            if first == "#" or t[0] == "\\" and t.endswith("\n"):
                return ""
        elif t.startswith("//"):
            return ""
        elif t.startswith("/*"):
            return ("\n" if "\n" in t else "") if len(t) > 3 and t.endswith("*/") else "E"
        if first.isspace() or t == "﻿":
            return ""
        if len(t) > 1 and (first in "\"'`" or lang == "py" and t[-1] in "\"'" and first in "rRbBuUfF"):
            return "s"
        if lang in ("js", "ts") and first == "/" and len(t) > 1:
            return "s"
        if first.isdigit() or first == "." and len(t) > 1 and t[1].isdigit():
            return "n" if _NUMBER.fullmatch(t) else "E"
        if first.isalpha() or first == "_" or first == "$" and lang in ("js", "ts", "java") or first == "#" and len(t) > 1 and lang in ("js", "ts"):
            return "i" if "$" not in t or lang in ("js", "ts", "java") else "E"
        return "E"


_EXPR = """
expr : unary | expr 'o' unary | expr '-' unary | expr '*' unary | expr '<' unary | expr '>' unary | expr '>' '>' unary | expr '>' '>' '>' unary {more}
unary : '!' unary | '-' unary | post {unary}
exprs : expr | exprs ',' expr
"""

GO = _EXPR.format(more="", unary="| '*' unary | 'C' unary | 'p' unary") + """
post : prim | post '.' ID | post '.' (type) | post '.' (typesw) | post (args) | post [index]
prim : ID | NUM | STR | (expr) | 'func' (params) result? {stmts} | literal | conv (expr) | conv (args) | 'func' (params) result? {stmts} (args)
literal : ltype {elems} | 'struct' {fields} {elems}
ltype : name | slice | 'map' [type] type
conv : slice | 'chan' type | 'map' [type] type | 'interface' {imembers} | (type)
slice : [none] type | [size] type
none :
size : expr | 'V'
typesw : 'type'
name : ID | name '.' ID | name [types]
index : expr | expr? ':' expr? | expr? ':' expr ':' expr | type
args : | alist ','? | alist 'V' ','?
alist : arg | alist ',' arg
arg : expr | type
elems : | elist ','?
elist : elem | elist ',' elem
elem : value | value ':' value
value : expr | {elems}
union : uterm | union 'o' uterm
uterm : type | '!' type
type : name | '*' type | slice | 'map' [type] type | 'chan' type | 'C' 'chan' type | 'chan' 'C' type | 'func' (params) result? | 'struct' {fields} | 'interface' {imembers} | (type)
types : type | types ',' type
params : | plist ','?
plist : param | plist ',' param
param : ID | ID union | ID 'V' type | type | 'V' type
result : type | (params)
fields : | flist ';'?
flist : field | flist ';' field
field : ids type STR? | type STR?
imembers : | imlist ';'?
imlist : imember | imlist ';' imember
imember : ID (params) result? | union
funit : flist ';'? | ';'
imunit : imlist ';'? | ';'
ids : ID | ids ',' ID
simple : expr | exprs '=' exprs | expr '~' expr | ids 'D' exprs | post 'p' | expr 'C' expr
block : {stmts}
ifst : 'if' simple block els? | 'if' simple ';' expr block els? | 'if' simple ';' simple block els?
els : 'else' ifst | 'else' block
forst : 'for' block | 'for' expr block | 'for' simple? ';' expr? ';' simple? block | 'for' exprs '=' 'range' expr block | 'for' ids 'D' 'range' expr block | 'for' 'range' expr block
switch : 'switch' {cases} | 'switch' simple {cases} | 'switch' simple ';' expr? {cases} | 'select' {cases}
stmt : simple | block | ifst | forst | switch | 'return' exprs? | 'go' expr | 'defer' expr | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | ID ':' | ID ':' stmt | decl | stmt ';' | ';'
cstmt : stmt | kases | kases stmt
kases : kase | kases kase
kase : 'case' exprs ':' | 'case' types ':' | 'case' ids 'D' expr ':' | 'case' exprs '=' expr ':' | 'case' expr 'C' expr ':' | 'default' ':'
decl : 'var' vspec | 'var' (vspecs) | 'const' cspec | 'const' (cspecs) | 'type' tspec | 'type' (tspecs)
vspec : ids type | ids type '=' exprs | ids '=' exprs
cspec : ids | ids '=' exprs | ids type '=' exprs
tspec : ID type | ID '=' type | ID [params] type
vspecs : | vlist ';'?
vlist : vspec | vlist ';' vspec
cspecs : | clist ';'?
clist : cspec | clist ';' cspec
tspecs : | tlist ';'?
tlist : tspec | tlist ';' tspec
importspec : STR | ID STR | '.' STR
imports : | ilist ';'?
ilist : importspec | ilist ';' importspec
func : 'func' ID (params) result? block | 'func' (params) ID (params) result? block | 'func' ID [params] (params) result? block | 'func' ID (params) result?
top : 'package' ID | 'import' importspec | 'import' (imports) | func | decl | top ';' | ';'
"""

_JS = """
post : prim | post '.' ID | post '.' [index] | post '.' (args) | post (args) | post [index] | post 'p' | post STR | 'p' post
prim : name | NUM | STR | (expr) | (seq) | [elems] | {object} | fun | cls | 'import' (args) | 'import' '.' ID
name : ID | 'from' | 'of' | 'as' | 'get' | 'set' | 'async' | 'static' {names}
fun : 'async'? 'function' '*'? name? sig {stmts}
arrow : name 'A' body | 'async' name 'A' body | sigparams 'A' body | 'async' sigparams 'A' body
body : expr | {stmts}
cls : 'class' name? heritage? {members}
index : seq
seq : expr | seq ',' expr
args : | alist ','?
alist : arg | alist ',' arg
arg : expr | 'V' expr
elems : | elist ','?
elist : arg | elist ',' arg | ',' elist | elist ',' ',' arg
object : | olist ','?
olist : prop | olist ',' prop
prop : key ':' expr | name | name '=' expr | method | 'V' expr
key : name | NUM | STR | [expr]
method : 'async'? '*'? key sig {stmts} | 'get' key sig {stmts} | 'set' key sig {stmts}
pattern : name | [pelems] | {pobject}
pelems : | pelist ','?
pelist : pelem | pelist ',' pelem | ',' pelist | pelist ',' ',' pelem
pelem : pattern | pattern '=' expr | 'V' pattern
pobject : | polist ','?
polist : pprop | polist ',' pprop
pprop : name | name '=' expr | key ':' pattern | key ':' pattern '=' expr | 'V' name
params : | plist ','?
plist : param | plist ',' param
lhs : name | post '.' ID | post [index] | [elems] | {object}
kind : 'const' | 'let' | 'var'
vdecl : 'let' vars | 'var' vars | 'const' cvars
cvars : cvar | cvars ',' cvar
vars : var | vars ',' var
forhead : kind pattern 'of' expr | kind pattern 'in' seq | lhs 'of' expr | lhs 'in' seq | finit? ';' seq? ';' seq?
finit : kind vars | seq
block : {stmts}
catch : 'catch' (catchp) block | 'catch' block
catchp : param
stmt : seq ';'? | vdecl ';'? | block | ';' | stmt ';' | 'if' (seq) stmt | 'if' (seq) stmt 'else' stmt | 'for' (forhead) stmt | 'for' '!' (forhead) stmt | 'while' (seq) stmt | 'do' stmt 'while' (seq) ';'? | 'return' seq? ';'? | 'throw' seq ';'? | 'break' name? ';'? | 'continue' name? ';'? | 'debugger' ';'? | 'try' block catch | 'try' block catch 'finally' block | 'try' block 'finally' block | 'switch' (seq) {cases} | fundecl | cls | name ':' stmt {stmt}
cstmt : stmt | kases | kases stmt
kases : kase | kases kase
kase : 'case' seq ':' | 'default' ':'
fundecl : 'async'? 'function' '*'? name sig {stmts}
member : method | 'static' method | 'static' {stmts} | key ';' | key '=' expr ';'? | 'static' key '=' expr ';'? | ';' | member ';' {member}
impspec : name | name 'as' name | 'default' 'as' name | STR 'as' name
implist : | imps ','?
imps : impspec | imps ',' impspec
clause : name | {implist} | '*' 'as' name | name ',' {implist} | name ',' '*' 'as' name
expspec : name | name 'as' name | name 'as' 'default' | 'default' | 'default' 'as' name
explist : | exps ','?
exps : expspec | exps ',' expspec
top : stmt | 'import' clause 'from' STR ';'? | 'import' STR ';'? | 'export' vdecl ';'? | 'export' fundecl | 'export' cls | 'export' 'default' expr ';'? | 'export' 'default' fun | 'export' {explist} ';'? | 'export' {explist} 'from' STR ';'? | 'export' '*' 'from' STR ';'? | 'export' '*' 'as' name 'from' STR ';'? {top}
"""
_JSEXPR = _EXPR.format(more="| expr 'in' unary | expr '?' expr ':' expr | 'yield' | 'yield' expr | 'yield' '*' expr | lhs '=' expr | lhs '~' expr | arrow | expr 'o' arrow", unary="")
JS = _JSEXPR + _JS.replace(" {names}", "").replace(" {stmt}", "").replace(" {member}", "").replace(" {top}", "") + """
sig : (params)
sigparams : (params)
heritage : 'extends' post
param : pattern | pattern '=' expr | 'V' pattern
var : pattern | pattern '=' expr
cvar : pattern '=' expr
"""
TS = _JSEXPR.replace("unary : '!' unary", "unary : '!' unary | '<' type '>' unary", 1).replace("| arrow", "| arrow | expr 'as' type | expr 'as' 'const' | expr 'satisfies' type", 1) + (
    _JS.replace(" {names}", " | 'type' | 'is' | 'namespace' | 'keyof' | 'interface'").replace(" {stmt}", " | tdecl").replace("post : prim", "post : prim | post '!' | post '<' types '>' (args)")
    .replace(" {member}", " | mods member | decos member | key '?' sig ';'? | key '?' sig {stmts} | [tindex] ':' type | key '?' ':' type ';'? | key ':' type ';'? | key ':' type '=' expr ';'? | key '!' ':' type ';'? | key sig ';' | [tindex] ':' type ';'? | 'static' key ':' type '=' expr ';'? | 'static' key ':' type ';'?")
    .replace(" {top}", " | decos top | 'export' tdecl | 'export' 'mod' cls | 'export' 'default' tdecl | 'export' 'default' 'mod' cls | 'export' '=' expr ';'? | 'export' 'as' 'namespace' name ';'? | 'export'? 'import' 'type'? name '=' expr ';'? | 'export' 'type' {explist} 'from' STR ';'? | 'export' 'type' '*' 'from' STR ';'? | 'export' 'type' '*' 'as' name 'from' STR ';'? | 'import' 'type' clause 'from' STR ';'? | 'export' 'type' {explist} ';'? | 'mod' top")
) + """
mods : 'mod' | mods 'mod' | 'static' 'mod' | mods 'static'
deco : '@' ID | deco '.' ID | deco (args)
decos : deco | decos deco
impspec : 'type' name | 'type' name 'as' name
expspec : 'type' name | 'type' name 'as' name
fundecl : 'async'? 'function' '*'? name sig ';'
cvar : pattern '=' expr | pattern ':' type '=' expr | pattern ':' type
sig : (params) | (params) ':' type | '<' tparams '>' (params) | '<' tparams '>' (params) ':' type
sigparams : (params) | (params) ':' type | '<' tparams ','? '>' (params) | '<' tparams ','? '>' (params) ':' type
tparams : tparam | tparams ',' tparam
tparam : 'const'? name | 'const'? name 'extends' type | name '=' type | name 'extends' type '=' type
heritage : 'extends' tref | 'implements' trefs | '<' tparams '>' 'implements' trefs | '<' tparams '>' 'extends' tref 'implements' trefs | 'extends' tref 'implements' trefs | '<' tparams '>' | '<' tparams '>' 'extends' tref
tref : name | tref '.' ID | tref '<' types '>'
trefs : tref | trefs ',' tref
param : pattern | pattern '=' expr | 'V' pattern | pattern ':' type | pattern '?' ':' type | pattern '?' | pattern ':' type '=' expr | 'V' pattern ':' type | mods param | decos param
var : pattern | pattern '=' expr | pattern ':' type | pattern ':' type '=' expr
type : utype | type 'o' utype | 'o' utype | utype 'extends' utype '?' type ':' type
utype : tref | utype [none] | utype [type] | STR | NUM | '!' | '!' tref | '-' NUM | '!' (params) 'A' type | '!' '<' tparams '>' (params) 'A' type | 'mod' '!' (params) 'A' type | itype | '!' itype | 'keyof' utype | 'mod' utype | {tobject} | [ttuple] | (type) | (params) 'A' type | '<' tparams '>' (params) 'A' type | name 'is' type
itype : 'import' (args) | itype '.' ID | itype '<' types '>'
none :
types : type | types ',' type
ttuple : | telems ','?
telems : telem | telems ',' telem
telem : type | type '?' | name ':' type | name '?' ':' type | 'V' type | 'V' name ':' type
tobject : | tolist tsep?
tolist : tmember | tolist tsep tmember
tsep : ';' | ','
tunit : tolist tsep? | ';'
tmember : key ':' type | key '?' ':' type | 'mod' key ':' type | 'mod' key '?' ':' type | key sig | key '?' sig | sig | '!' sig | 'get' key sig | 'set' key sig | tpre? [tindex] topt? ':' type
tpre : 'mod' | '-' 'mod'
topt : '?' | '-' '?'
tindex : name ':' type | name 'in' type | name 'in' type 'as' type
tdecl : 'interface' name {tobject} | 'interface' name theritage {tobject} | 'type' name '=' type ';'? | 'type' name '<' tparams '>' '=' type ';'? | 'enum' name {enums} | 'const' 'enum' name {enums} | 'namespace' dotted {tops} | 'namespace' STR {tops} | 'namespace' STR ';'? | 'mod' tdecl | 'mod' cls | 'mod' kind vars ';'? | 'mod' fundecl
dotted : name | dotted '.' name
theritage : 'extends' trefs | '<' tparams '>' | '<' tparams '>' 'extends' trefs
enums : | enlist ','?
enlist : enum | enlist ',' enum
enum : key | key '=' expr
"""

JAVA = _EXPR.format(more="| expr '?' expr ':' expr | lhs '=' expr | lhs '~' expr | expr 'instanceof' itype | expr 'instanceof' mods? type ID | expr 'instanceof' rpattern | lambda | (itype) lambda", unary="| (itype) unary | 'p' unary") + """
post : prim | post '.' ID | post '.' '<' targs '>' ID | post '.' 'super' | post '.' 'class' | post '.' 'this' | post '.' new | post (args) | post [expr] | post 'p' | post 'M' ID | post 'M' 'new' | ptype '.' 'class' | ptype 'M' 'new'
prim : ID | NUM | STR | (expr) | 'this' | 'super' | new | 'switch' (expr) {cases}
itype : type | itype 'o' type
rpattern : cref (rparams) | cref (rparams) ID
rparams : | rpl
rpl : rparam | rpl ',' rparam
rparam : mods? type ID | rpattern
new : 'new' cref (args) | 'new' cref (args) {members} | 'new' cref dims | 'new' 'prim' dims | 'new' cref [none] {inits} | 'new' 'prim' [none] {inits}
dims : [expr] | dims [expr] | dims [none]
lambda : ID 'R' lbody | (ids) 'R' lbody | (params) 'R' lbody
lbody : expr | {stmts}
ids : | idl
idl : ID | idl ',' ID
lhs : ID | post '.' ID | post [expr]
args : | exprs
none :
cref : ID | cref '.' ID | cref '<' targs '>' | cref '<' '>'
targs : targ | targs ',' targ
targ : type | '?' | '?' 'extends' type | '?' 'super' type
ptype : 'prim' | ptype [none]
type : cref | 'prim' | type [none]
inits : | inl ','?
inl : init | inl ',' init
init : expr | {inits}
var : ID | ID '=' init | ID [none] | ID [none] '=' init
vars : var | vars ',' var
mods : 'mod' | 'static' | 'default' | 'synchronized' | mods 'mod' | mods 'static' | mods 'default' | mods 'synchronized'
params : | plist
plist : param | plist ',' param
param : mods? type ID | mods? type 'V' ID | mods? type ID [none] | mods? type 'this'
throws : 'throws' crefs
crefs : cref | crefs ',' cref
effect : lhs '=' expr | lhs '~' expr | post (args) | post 'p' | 'p' unary | new | post '.' new
block : {stmts}
forhead : finit? ';' expr? ';' effects? | mods? type ID ':' expr
finit : mods? type vars | effects
effects : effect | effects ',' effect
catches : 'catch' (catchp) block | catches 'catch' (catchp) block
catchp : mods? ctypes ID
ctypes : cref | ctypes 'o' cref
tryres : res ';'? | tryres ';' res
res : mods? type ID '=' expr | expr
stmt : effect ';' | mods? type vars ';' | block | ';' | 'if' (expr) stmt | 'if' (expr) stmt 'else' stmt | 'for' (forhead) stmt | 'while' (expr) stmt | 'do' stmt 'while' (expr) ';' | 'return' expr? ';' | 'throw' expr ';' | 'break' ID? ';' | 'continue' ID? ';' | 'assert' expr ';' | 'assert' expr ':' expr ';' | 'try' block catches | 'try' block catches 'finally' block | 'try' block 'finally' block | 'try' (tryres) block | 'try' (tryres) block catches | 'try' (tryres) block 'finally' block | 'try' (tryres) block catches 'finally' block | 'synchronized' (expr) block | 'switch' (expr) {cases} | ID ':' stmt | decl
cstmt : stmt | kases | kases stmt | akase
kases : kase | kases kase
kase : 'case' labels ':' | 'default' ':'
akase : 'case' labels 'R' abody | 'default' 'R' abody
abody : expr ';' | block | 'throw' expr ';'
labels : label | labels ',' label
label : expr | 'default' | casep | casep '@when' expr
casep : mods? type ID | rpattern
tparams : '<' tpl '>'
tpl : tparam | tpl ',' tparam
tparam : ID | ID 'extends' itype
sup : sup1 | sup1 '@permits' crefs | '@permits' crefs
sup1 : 'extends' cref | 'implements' crefs | 'extends' cref 'implements' crefs
decl : mods? 'class' ID tparams? sup? {members} | mods? 'interface' ID tparams? {members} | mods? 'interface' ID tparams? 'extends' crefs {members} | mods? 'interface' ID tparams? '@permits' crefs {members} | mods? 'interface' ID tparams? 'extends' crefs '@permits' crefs {members} | mods? '@record' ID tparams? (params) {members} | mods? '@record' ID tparams? (params) 'implements' crefs {members} | mods? 'enum' ID {enums} | mods? 'enum' ID 'implements' crefs {enums} | mods? '@' 'interface' ID {members}
enums : | enl ','? | enl ','? ';'
enl : enum | enl ',' enum
enum : ID | ID (args) | ID {members} | ID (args) {members}
rtype : type | 'void'
member : mods? type vars ';' | mods? tparams? rtype ID (params) throws? block | mods? tparams? rtype ID (params) throws? ';' | mods? tparams? ID (params) throws? block | 'static' block | block | decl | ';' | mods? type ID (params) 'default' init? ';' | mods? tparams? type ID (params) [none] throws? block | mods? ID block
pname : ID | pname '.' ID
top : 'package' pname ';' | 'import' 'static'? pname ';' | 'import' 'static'? pname '.' '*' ';' | decl | ';'
"""

PYTHON = """
expr : test | lambda | test 'if' test 'else' expr | ID 'D' expr
lambda : 'lambda' largs? ':' expr
lparams : lpos | lpos ',' ldef | lpos ',' ltail | lpos ',' ldef ',' ltail | ldef | ldef ',' ltail | ltail
lpos : ID | lpos ',' ID | lpos ',' 'o'
ldef : ID '=' expr | ldef ',' ID '=' expr | ldef ',' 'o'
ltail : lstar | lstar ',' 'W' ID | 'W' ID
lstar : '*' ID | '*' ',' lnamed | lstar ',' lnamed
lnamed : ID | ID '=' expr
largs : lparams ','?
test : unary | test 'o' unary | test '-' unary | test '*' unary | test '<' unary | test '>' unary | test '>' '>' unary | test 'in' unary | test 'is' unary | test 'not' 'in' unary | test '@' unary | test 'W' unary
unary : '!' unary | '-' unary | 'not' unary | post
post : prim | post '.' ID | post (args) | post [index]
prim : ID | NUM | strs | (tuple) | [list] | {dict} | 'V'
strs : STR | strs STR
star : expr | '*' test
stars : star | stars ',' star
comp : 'for' targets 'in' test | 'async' 'for' targets 'in' test | comp 'for' targets 'in' test | comp 'if' cond
cond : test | lambda | ID 'D' test
tuple : | stars ','? | star comp | yield
list : | stars ','? | star comp
yield : 'yield' | 'yield' stars | 'yield' 'from' expr
index : sl | index ',' sl | index ','
sl : expr | expr? ':' expr? | expr? ':' expr? ':' expr? | '*' expr
args : | alist ','? | expr comp
alist : pargs | pargs ',' kargs | pargs ',' kargs ',' wargs | pargs ',' wargs | kargs | kargs ',' wargs | wargs
pargs : parg | pargs ',' parg
parg : expr | '*' expr
kargs : ID '=' expr | kargs ',' ID '=' expr | kargs ',' '*' expr
wargs : 'W' expr | wargs ',' ID '=' expr | wargs ',' 'W' expr
dict : | dlist ','? | stars ','? | star comp | expr ':' expr comp
dlist : pair | dlist ',' pair
pair : expr ':' expr | 'W' test
target : ID | post '.' ID | post [index] | (targets) | [targets] | '*' target
targets : target | targets ',' target | targets ','
value : stars | stars ',' | yield
assign : targets '=' value | targets '=' assign
small : value | assign | target '~' value | target ':' expr | target ':' expr '=' value | 'return' | 'return' value | 'raise' | 'raise' expr | 'raise' expr 'from' expr | 'pass' | 'break' | 'continue' | 'del' targets | 'global' ids | 'nonlocal' ids | 'assert' expr | 'assert' expr ',' expr | 'import' dotas | 'from' dots? dotted 'import' names | 'from' dots 'import' names
dots : '.' | 'V' | dots '.' | dots 'V'
ids : ID | ids ',' ID
dotted : ID | dotted '.' ID
dotas : dota | dotas ',' dota
dota : dotted | dotted 'as' ID
names : '*' | nlist | (nparen)
nparen : nlist ','?
nlist : namea | nlist ',' namea
namea : ID | ID 'as' ID
smalls : small | smalls ';' small
line : smalls ';'?
params : | plist ','?
plist : pos | pos ',' dflt | pos ',' tail | pos ',' dflt ',' tail | dflt | dflt ',' tail | tail
pos : p | pos ',' p | pos ',' 'o'
dflt : d | dflt ',' d | dflt ',' 'o'
p : ID | ID ':' expr
d : ID '=' expr | ID ':' expr '=' expr
tail : pstar | pstar ',' kw | kw
pstar : '*' ID | '*' ID ':' star | '*' ',' named | pstar ',' named
named : p | d
kw : 'W' ID | 'W' ID ':' expr
head : 'if' cond2 | 'while' cond2 | 'for' targets 'in' stars ','? | 'async' 'for' targets 'in' stars | def | 'class' ID | 'class' ID (args) | 'class' ID [tparams] | 'class' ID [tparams] (args) | withst | 'async' withst | 'try'
def : 'async'? 'def' ID (params) | 'async'? 'def' ID (params) 'R' expr | 'async'? 'def' ID [tparams] (params) | 'async'? 'def' ID [tparams] (params) 'R' expr
tparams : tpl ','?
tpl : tp | tpl ',' tp
tp : ID | ID ':' expr | '*' ID | 'W' ID | ID '=' expr | ID ':' expr '=' expr
matchhead : '@match' stars ','?
casehead : '@case' stars ','? | '@case' stars ','? 'if' cond2
typest : '@type' ID '=' expr | '@type' ID [tparams] '=' expr
withst : 'with' items | 'with' (wparen)
wparen : items ','?
items : item | items ',' item
item : expr | expr 'as' target
cond2 : expr
elsehead : 'else'
elifhead : 'elif' cond2
exhead : 'except' | 'except' stars | 'except' expr 'as' ID | 'except' '*' expr | 'except' '*' expr 'as' ID
finhead : 'finally'
deco : '@' expr
"""
GRAMMARS = {"go": GO, "js": JS, "ts": TS, "java": JAVA, "py": PYTHON}
#: Rules for the content of braces that are lists of units, and the rule of a unit.
LISTS = {
    "go": {"stmts": "stmt", "cases": "cstmt", "fields": "funit", "imembers": "imunit"}, "js": {"stmts": "stmt", "cases": "cstmt", "members": "member"},
    "ts": {"stmts": "stmt", "cases": "cstmt", "members": "member", "tobject": "tunit", "tops": "top"}, "java": {"stmts": "stmt", "cases": "cstmt", "members": "member"}, "py": {},
}
EXTENSION = {".go": "go", ".py": "py", ".js": "js", ".jsx": "js", ".mjs": "js", ".ts": "ts", ".tsx": "ts", ".java": "java"}
