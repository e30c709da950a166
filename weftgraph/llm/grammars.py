"""Grammars and token rules of the languages that `syntax` parses.

Operators are grouped into classes, since precedence does not matter to a recogniser. Grammars follow the public
language references; they accept every construct listed there that programs commonly use and leave names and
types unchecked.
"""

from __future__ import annotations

PYTHON = r"""
file: {stmt}
stmt: simple NEWLINE | compound
simple: small {';' small} [';']
small: starexprs | assignment | 'pass' | 'break' | 'continue' | 'return' [starexprs] | 'raise' [expr ['from' expr]]
  | 'global' name {',' name} | 'nonlocal' name {',' name} | 'del' dels | 'assert' expr [',' expr] | imp | yield
  | 'type' name [typarams] '=' expr
assignment: single ASG (yield | starexprs) | targets {'=' targets} '=' (yield | starexprs) | single ':' expr ['=' (yield | starexprs)]
place: name | primary '.' name | primary '[' slices ']'
single: place | '(' single ')'
target: place | '(' [targets] ')' | '[' [targets] ']'
targets: startarget {',' startarget} [',']
startarget: target | '*' target
dels: deleted {',' deleted} [',']
deleted: place | '(' [dels] ')' | '[' [dels] ']'
imp: 'import' dotted ['as' name] {',' dotted ['as' name]} | 'from' fromname 'import' ('*' | names | '(' names [','] ')')
fromname: dots | dots dotted | dotted
dots: '.' | '...' | dots '.' | dots '...'
names: name ['as' name] {',' name ['as' name]}
dotted: name {'.' name}
name: ID | 'match' | 'case' | 'type' | '_'
block: simple NEWLINE | NEWLINE INDENT stmts DEDENT
stmts: stmt | stmts stmt
compound: 'if' named ':' block {'elif' named ':' block} ['else' ':' block]
  | 'while' named ':' block ['else' ':' block]
  | 'for' targets 'in' starexprs ':' block ['else' ':' block]
  | 'try' ':' block ((excepts ['else' ':' block] ['finally' ':' block]) | 'finally' ':' block)
  | 'with' withitems ':' block | 'with' '(' withitems [','] ')' ':' block
  | decorators definition | definition
  | 'async' 'for' targets 'in' starexprs ':' block ['else' ':' block] | 'async' 'with' withitems ':' block
  | 'match' starexprs ':' NEWLINE INDENT cases DEDENT
cases: case | cases case
case: 'case' patterns ['if' named] ':' block
patterns: (aspattern | '*' name) {',' (aspattern | '*' name)} [',']
aspattern: orpattern ['as' name]
orpattern: closed | orpattern BIN closed
closed: literal | dotted | '(' [patterns] ')' | '[' [patterns] ']' | '{' [pairs [',']] '}' | dotted '(' [parts [',']] ')'
literal: ['-'] NUM [('+' | '-') NUM] | strings | 'None' | 'True' | 'False'
pairs: pair {',' pair}
pair: (literal | dotted) ':' aspattern | '**' name
parts: part {',' part}
part: aspattern | name '=' aspattern
excepts: except | excepts except
except: 'except' ['*'] [exprs ['as' name]] ':' block
exprs: expr {',' expr}
withitems: withitem {',' withitem}
withitem: expr ['as' target]
decorators: '@' named NEWLINE {'@' named NEWLINE}
definition: ['async'] 'def' name [typarams] '(' [params] ')' ['->' expr] ':' block
  | 'class' name [typarams] ['(' [args] ')'] ':' block
typarams: '[' typaram {',' typaram} [','] ']'
typaram: name [':' expr] ['=' expr] | '*' name | '**' name
params: positional [','] | positional ',' starred | starred
positional: plains | plains ',' defaults | defaults
plains: name [':' expr] | plains ',' name [':' expr] | plains ',' '/'
defaults: name [':' expr] '=' expr | defaults ',' name [':' expr] '=' expr | defaults ',' '/' | plains ',' '/' ',' name [':' expr] '=' expr
starred: '*' name [':' starexpr] {',' named1} [',' doubled] [','] | '*' {',' named1} ',' named1 [',' doubled] [','] | doubled [',']
named1: name [':' expr] ['=' expr]
doubled: '**' name [':' expr]
starexprs: starexpr {',' starexpr} [',']
starexpr: named | '*' bitor
named: expr | name ':=' expr
expr: ortest | ortest 'if' ortest 'else' expr | 'lambda' [lparams] ':' expr
lparams: lpositional [','] | lpositional ',' lstarred | lstarred
lpositional: lplains | lplains ',' ldefaults | ldefaults
lplains: name | lplains ',' name | lplains ',' '/'
ldefaults: name '=' expr | ldefaults ',' name '=' expr | ldefaults ',' '/'
lstarred: '*' name {',' lnamed} [',' ldoubled] [','] | '*' {',' lnamed} ',' lnamed [',' ldoubled] [','] | ldoubled [',']
lnamed: name ['=' expr]
ldoubled: '**' name
ortest: nottest | ortest ('or' | 'and') nottest
nottest: comparison | 'not' nottest
comparison: bitor | comparison ('<' | '>' | CMP | 'in' | 'not' 'in' | 'is' | 'is' 'not') bitor
bitor: factor | bitor (BIN | '+' | '-' | '*' | '**' | '/' | '@') factor
factor: power | ('+' | '-' | '~') factor
power: ['await'] primary
primary: atom | primary '.' name | primary '(' [args] ')' | primary '[' slices ']'
slices: slice {',' slice} [',']
slice: named | '*' bitor | [expr] ':' [expr] [':' [expr]]
args: named comps [','] | places [','] | places ',' keywords [','] | keywords [',']
places: (named | '*' expr) {',' (named | '*' expr)}
keywords: keyword | keyword ',' doubles | doubles
keyword: name '=' expr | keyword ',' (name '=' expr | '*' expr)
doubles: '**' expr | doubles ',' ('**' expr | name '=' expr)
comps: comp | comps comp
comp: ['async'] 'for' targets 'in' ortest {'if' nocond}
nocond: ortest | 'lambda' [lparams] ':' nocond | name ':=' ortest
atom: name | NUM | strings | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' (yield | starexprs | named comps) ')'
  | '[' ']' | '[' (starexprs | named comps) ']' | '{' '}' | '{' (dict | starexprs | named comps) '}'
dict: item {',' item} [','] | item comps
item: expr ':' expr | '**' bitor
strings: STR | strings STR
yield: 'yield' [starexprs] | 'yield' 'from' expr
"""

_JS = r"""
program: {item}
item: statement | declaration | 'import' import eos | export
import: STR | default ['from' STR] | (clause | default ',' clause) 'from' STR
default: bind
clause: '{' [specs [',']] '}' | '*' 'as' bind
specs: spec {',' spec}
spec: word | word 'as' word | STR 'as' word
export: 'export' (declaration | '{' [specs [',']] '}' ['from' STR] eos | '*' ['as' word] 'from' STR eos)
  | 'export' 'default' (funcdecl | classdecl | expr1 eos)
eos: ';'
declaration: funcdecl | classdecl | lexical eos
lexical: ('const' | 'let' | 'var') vars
vars: var {',' var}
var: target ['=' expr1]
funcdecl: ['async'] 'function' ['*'] [bind] signature block
signature: '(' [params [',']] ')'
params: param {',' param}
param: target ['=' expr1] | '...' target
target: bind | '[' [elems] ']' | '{' [props [',']] '}'
elems: elem | elems ',' | elems ',' elem | ',' | ',' elem
elem: target ['=' expr1] | '...' target
props: prop {',' prop}
prop: bind ['=' expr1] | key ':' target ['=' expr1] | '...' target
key: word | STR | NUM | '[' expr1 ']'
classdecl: {decorator} 'class' [bind] [heritage] '{' {member} '}'
decorator: '@' postfix
heritage: 'extends' postfix
member: ';' | {decorator} {modifier} method | {decorator} {modifier} field eos | 'static' block
modifier: 'static' | 'async' | 'get' | 'set' | '*'
method: mkey signature block
mkey: key | PRIVATE
field: mkey ['=' expr1]
block: '{' {stmt} '}'
stmt: statement | declaration
statement: block | 'var' vars eos | ';' | expr eos | if | loop | 'continue' [ID] eos | 'break' [ID] eos | 'return' [expr] eos
  | 'throw' expr eos | try | 'switch' '(' expr ')' '{' {branch} '}' | ID ':' statement | 'debugger' eos | 'with' '(' expr ')' statement
if: 'if' '(' expr ')' statement ['else' statement]
loop: 'do' statement 'while' '(' expr ')' eos | 'do' statement 'while' '(' expr ')' | 'while' '(' expr ')' statement
  | 'for' ['await'] '(' forhead ')' statement
forhead: [expr | lexical] ';' [expr] ';' [expr] | (('const' | 'let' | 'var') target | place) ('in' | 'of') expr
place: bind | postfix '.' (word | PRIVATE) | postfix '[' expr ']' | postfix args | '(' expr ')' | array | object
try: 'try' block ('catch' ['(' target ')'] block ['finally' block] | 'finally' block)
branch: ('case' expr | 'default') ':' {stmt}
expr: expr1 {',' expr1}
expr1: cond | place ('=' | ASG) expr1 | arrow | 'yield' ['*'] [expr1] | pattern '=' expr1
pattern: '[' [elems] ']' | '{' [props [',']] '}'
arrow: ['async'] bind '=>' (expr1 | block) | ['async'] signature '=>' (expr1 | block)
cond: binary ['?' expr1 ':' expr1]
binary: unary | binary binop unary
binop: BIN | '+' | '-' | '*' | '/' | '<' | '>' | CMP | 'in' | 'instanceof'
unary: postfix | place INC | INC place | ('+' | '-' | '!' | '~' | 'typeof' | 'void' | 'delete' | 'await') unary | PRIVATE
postfix: primary | postfix '.' (word | PRIVATE) | postfix '?.' (word | PRIVATE) | postfix ['?.'] '[' expr ']' | postfix ['?.'] args | postfix TPL
  | 'new' postfix | 'new' '.' word
args: '(' [arglist [',']] ')'
arglist: arg {',' arg}
arg: expr1 | '...' expr1
primary: bind | 'this' | 'super' | 'null' | 'true' | 'false' | NUM | STR | TPL | REGEX | '(' expr ')' | array | object | 'import'
  | ['async'] 'function' ['*'] [bind] signature block | {decorator} 'class' [bind] [heritage] '{' {member} '}'
array: '[' [items] ']'
items: arg | ',' | items ',' | items ',' arg
object: '{' [entries [',']] '}'
entries: entry {',' entry}
entry: bind | key ':' expr1 | '...' expr1 | ('async' | 'get' | 'set' | '*') method | 'async' '*' method | method | bind '=' expr1
bind: ID | SOFT
SOFTLIST
"""

_JS_SOFT = ["as", "async", "from", "get", "set", "of", "static", "await", "yield", "let"]
_JS_HARD = [
    "break", "case", "catch", "class", "const", "continue", "debugger", "default", "delete", "do", "else", "export", "extends",
    "finally", "for", "function", "if", "import", "in", "instanceof", "new", "null", "return", "super", "switch", "this", "throw",
    "true", "false", "try", "typeof", "var", "void", "while", "with", "enum",
]

_TS = r"""
item: tsdecl | 'import' bind '=' expr1 eos | 'export' '=' expr1 eos | 'import' 'type' (default | clause | default ',' clause) 'from' STR eos
  | 'export' 'type' '{' [specs [',']] '}' ['from' STR] eos | 'export' 'as' 'namespace' bind eos
spec: 'type' word | 'type' word 'as' word
stmt: tsdecl
export: 'export' tsdecl | 'export' 'default' ('interface' bind [tparams] ['extends' types] tbody | 'abstract' classdecl)
tsdecl: 'interface' bind [tparams] ['extends' types] tbody | 'type' bind [tparams] '=' type eos | ['const'] 'enum' bind '{' [enums [',']] '}'
  | ('namespace' | 'module') qname '{' {item} '}' | 'module' STR '{' {item} '}' | 'declare' (tsdecl | declaration | 'global' '{' {item} '}' | ambient)
  | 'abstract' classdecl | ambient
ambient: ['async'] 'function' ['*'] [bind] signature eos
enums: enumitem {',' enumitem}
enumitem: key ['=' expr1]
qname: bind {'.' word}
signature: [tparams] '(' [params [',']] ')' ':' rtype | tparams '(' [params [',']] ')'
rtype: type | bind 'is' type | 'asserts' bind ['is' type] | 'this' 'is' type
param: {decorator} {access} target ['?'] [':' type] ['=' expr1] | '...' target ':' type | 'this' ':' type
access: 'public' | 'private' | 'protected' | 'readonly' | 'override'
classdecl: {decorator} 'class' [bind] [tparams] [heritage] [implements] '{' {member} '}'
heritage: 'extends' postfix targs
implements: 'implements' types
types: type {',' type}
modifier: access | 'abstract' | 'declare' | 'accessor'
member: {decorator} {modifier} mkey signature eos | {decorator} {modifier} mkey '?' signature (eos | block) | {modifier} index eos
index: '[' bind ':' type ']' ':' type
field: mkey ['?' | '!'] ':' type ['=' expr1] | mkey '?'
var: target ['!'] ':' type ['=' expr1]
try: 'try' block 'catch' '(' target ':' type ')' block ['finally' block]
arrow: ['async'] signature '=>' (expr1 | block)
binary: binary ('as' | 'satisfies') (type | 'const')
postfix: postfix '!' | postfix targs args | 'new' postfix targs args | postfix targs TPL
unary: '<' type '>' unary
place: postfix '!' | postfix targs args
primary: ['async'] 'function' ['*'] [bind] tparams '(' [params [',']] ')' [':' rtype] block
targs: '<' types '>'
tparams: '<' tparam {',' tparam} [','] '>'
tparam: ['const' | 'in' | 'out'] bind ['extends' type] ['=' type]
type: union | union 'extends' union '?' type ':' type | functype | 'unique' type
functype: ['abstract'] ['new'] [tparams] '(' [params [',']] ')' '=>' rtype
union: ['|'] intersect {'|' intersect}
intersect: ['&'] tprefix {'&' tprefix}
tprefix: tpost | ('keyof' | 'readonly' | 'infer' | 'unique') tprefix | 'infer' bind 'extends' tpost
tpost: tprim | tpost '[' ']' | tpost '[' type ']'
tprim: tname [targs] | STR | TPL | ['-'] NUM | 'null' | 'true' | 'false' | 'void' | 'this' | '(' type ')' | tbody | '[' [telems [',']] ']'
  | 'typeof' tname [targs] | 'import' '(' STR ')' {'.' word} [targs] | mapped
tname: bind {'.' word}
telems: telem {',' telem}
telem: type | bind ['?'] ':' type | type '?' | '...' type | '...' bind ':' type
tbody: '{' {tmember} '}' | '{' {tmember} tm '}'
tmember: tm (';' | ',' | eos)
tm: {'readonly' | 'get' | 'set'} key ['?'] ':' type | {'readonly'} key '?' | key ['?'] signature | key ['?'] '(' [params [',']] ')' | key | signature | '(' [params [',']] ')' | 'new' signature | ['readonly'] index
mapped: '{' [['+' | '-'] 'readonly'] '[' bind 'in' type ['as' type] ']' [['+' | '-'] '?'] [':' type] [';'] '}'
"""
_TS_SOFT = [
    "type", "namespace", "module", "declare", "abstract", "is", "asserts", "public", "private", "protected", "readonly", "override",
    "implements", "interface", "keyof", "infer", "unique", "satisfies", "global", "accessor", "out",
]


def javascript(typescript: bool) -> str:
    soft = _JS_SOFT + (_TS_SOFT if typescript else [])
    hard = [x for x in _JS_HARD]
    text = _JS.replace("bind: ID | SOFT\n", "bind: ID | " + " | ".join(f"'{x}'" for x in soft) + "\n")
    text = text.replace("SOFTLIST", "word: bind | " + " | ".join(f"'{x}'" for x in hard))
    if typescript:
        text = text.replace("binop: BIN | ", "binop: BIN | '|' | '&' | '>' '>' | '>' '>' '>' | ").replace("('=' | ASG)", "('=' | ASG | '>' CMP | '>' '>' CMP)") + _TS
    return text


GO = r"""
file: 'package' ID ';' {imports ';'} {top ';'}
imports: 'import' (importspec | '(' {importspec ';'} [importspec] ')')
importspec: ['.' | ID] STR
top: decl | 'func' ID [tparams] signature [block] | 'func' '(' [params [',']] ')' ID signature [block]
decl: 'const' (constspec | '(' {constspec ';'} [constspec] ')') | 'var' (varspec | '(' {varspec ';'} [varspec] ')')
  | 'type' (typespec | '(' {typespec ';'} [typespec] ')')
constspec: ids [[type] '=' exprs]
varspec: ids (type ['=' exprs] | '=' exprs)
typespec: ID [tparams] ['='] type
ids: ID {',' ID}
tparams: '[' tparam {',' tparam} [','] ']'
tparam: ids constraint
constraint: term {'|' term}
term: ['~'] type
type: tname | '*' type | '[' [expr | '...'] ']' type | 'map' '[' type ']' type | 'chan' ['<-'] type | '<-' 'chan' type
  | 'func' signature | 'struct' '{' [fields [';']] '}' | 'interface' '{' [elems [';']] '}' | '(' type ')'
tname: ID ['.' ID] ['[' types [','] ']']
types: type {',' type}
fields: field {';' field}
field: ids type [STR] | ['*'] tname [STR]
elems: elem {';' elem}
elem: ID signature | constraint
signature: '(' [params [',']] ')' [result]
result: '(' [params [',']] ')' | type
params: param {',' param}
param: ['...'] type | ID ['...'] type
block: '{' stmts '}' | '{' '}'
stmts: stmt | ';' | stmts ';' | stmts ';' stmt
stmt: decl | simple | 'return' [exprs] | 'break' [ID] | 'continue' [ID] | 'goto' ID | 'fallthrough' | block | if | for | switch | select
  | 'go' expr | 'defer' expr | ID ':' [stmt]
simple: expr | expr INC | exprs ('=' | ASG) exprs | ids ':=' exprs | expr '<-' expr | ids ':=' 'range' expr | exprs '=' 'range' expr
if: 'if' [simple ';'] cexpr block ['else' (if | block)]
cexpr: expr
for: 'for' block | 'for' expr block | 'for' [simple] ';' [expr] ';' [simple] block | 'for' ids ':=' 'range' expr block | 'for' exprs '=' 'range' expr block | 'for' 'range' expr block
switch: 'switch' [simple ';'] [simple] '{' {clause} '}'
clause: ('case' caselist | 'default') ':' [stmts]
caselist: caseitem {',' caseitem}
caseitem: expr | type
select: 'select' '{' {comm} '}'
comm: ('case' simple | 'default') ':' [stmts]
exprs: expr {',' expr}
expr: unary | expr (BIN | '&' | '+' | '-' | '*' | '|') unary
unary: primary | ('+' | '-' | '!' | '*' | '<-' | '&' | BIN) unary
primary: operand | primary '.' ID | primary '.' '(' (type | 'type') ')' | primary '[' index ']' | primary '(' [args [',']] ')' | primary composite
index: expr [',' types] | [expr] ':' [expr] [':' expr] | type
args: arg {',' arg}
arg: expr ['...'] | type
operand: ID | NUM | STR | CHR | '(' expr ')' | '(' type ')' | 'func' signature block | littype composite
  | ('[' ']' type | 'map' '[' type ']' type | 'chan' type | 'struct' '{' '}' | 'interface' '{' '}') '(' [args] ')'
littype: '[' [expr | '...'] ']' type | 'map' '[' type ']' type | 'struct' '{' [fields [';']] '}'
composite: '{' [values [',']] '}'
values: value {',' value}
value: [(expr | composite) ':'] (expr | composite)
"""

JAVA = r"""
file: [{annotation} 'package' dotted ';'] {import} {type}
import: 'import' ['static'] dotted ['.' '*'] ';' | ';'
dotted: name {'.' name}
name: ID | 'record' | 'yield' | 'sealed' | 'permits' | 'when'
annotation: '@' dotted ['(' [annvalues] ')']
annvalues: annvalue {',' annvalue} [',']
annvalue: name '=' elementvalue | elementvalue
elementvalue: cond | '{' [elementvalue {',' elementvalue}] [','] '}' | annotation
modifier: annotation | MODIFIER | 'static' | 'final' | 'abstract' | 'default' | 'synchronized' | 'sealed' | 'non' '-' 'sealed'
type: {modifier} typedecl | ';'
typedecl: 'class' name [tparams] ['extends' ref] ['implements' refs] ['permits' refs] body
  | 'interface' name [tparams] ['extends' refs] ['permits' refs] body
  | 'enum' name ['implements' refs] '{' [constants] [','] [';' {member}] '}'
  | 'record' name [tparams] '(' [params] ')' ['implements' refs] body
  | '@' 'interface' name body
constants: constant {',' constant}
constant: {annotation} name ['(' [exprs] ')'] [body]
body: '{' {member} '}'
member: {modifier} typedecl | {modifier} [tparams] jtype name '(' [params] ')' {dims} ['throws' refs] (block | ['default' elementvalue] ';')
  | {modifier} [tparams] name '(' [params] ')' ['throws' refs] block | {modifier} name block | {modifier} jtype vars ';' | ['static'] block | ';'
tparams: '<' tparam {',' tparam} '>'
tparam: {annotation} name ['extends' ref {'&' ref}]
refs: ref {',' ref}
ref: {annotation} rawref
rawref: name [targs] | rawref '.' {annotation} name [targs]
targs: '<' [targ {',' targ}] '>'
targ: jtype | {annotation} '?' [('extends' | 'super') jtype]
jtype: (PRIM | ref) {dims} | annotation PRIM {dims}
dims: '[' ']'
params: param {',' param}
param: {modifier} jtype ['...'] name {dims} | {modifier} jtype 'this'
vars: var {',' var}
var: name {dims} ['=' init]
init: expr | '{' [init {',' init}] [','] '}'
block: '{' {stmt} '}'
stmt: block | ';' | {modifier} jtype vars ';' | {modifier} typedecl | effect ';' | 'if' '(' expr ')' stmt ['else' stmt] | 'while' '(' expr ')' stmt
  | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' [forinit] ';' [expr] ';' [effects] ')' stmt | 'for' '(' {modifier} jtype name ':' expr ')' stmt
  | 'return' [expr] ';' | 'break' [name] ';' | 'continue' [name] ';' | 'throw' expr ';' | 'yield' expr ';' | 'assert' expr [':' expr] ';'
  | 'synchronized' '(' expr ')' block | try | switch | name ':' stmt
forinit: {modifier} jtype vars | effects
effects: effect {',' effect}
effect: place ('=' | ASG | '>' CMP | '>' '>' CMP) expr | place INC | INC place | postfix '(' [exprs] ')' | postfix '.' 'new' ref '(' [exprs] ')' [body]
  | 'new' ref '(' [exprs] ')' [body]
place: name | postfix '.' name | postfix '[' expr ']' | '(' place ')'
exprs: expr {',' expr}
try: 'try' block catches ['finally' block] | 'try' block 'finally' block | 'try' '(' resource {';' resource} [';'] ')' block [catches] ['finally' block]
catches: catch | catches catch
catch: 'catch' '(' {modifier} ref {'|' ref} name ')' block
resource: {modifier} jtype name '=' expr | postfix
switch: 'switch' '(' expr ')' '{' {branch} '}'
branch: label ':' {stmt} | label '->' (expr ';' | block | 'throw' expr ';')
label: 'case' caseitem {',' caseitem} ['when' expr] | 'default'
caseitem: cond | pattern | 'default'
pattern: {modifier} jtype name | ref '(' [pattern {',' pattern}] ')' [name]
expr: cond | place ('=' | ASG | '>' CMP | '>' '>' CMP) expr | lambda
lambda: name '->' (expr | block) | '(' [params | names] ')' '->' (expr | block)
names: name {',' name}
cond: binary | binary '?' expr ':' (cond | lambda)
binary: unary | binary (BIN | CMP | '+' | '-' | '*' | '/' | '&' | '|' | '<' | '>' | '>' '>' | '>' '>' '>') unary | binary 'instanceof' (pattern | jtype)
unary: postfix | place INC | INC place | ('+' | '-' | '!' | '~') unary | '(' jtype {'&' jtype} ')' (unary | lambda) | switch
postfix: primary | postfix '.' [targs] name | postfix '(' [exprs] ')' | postfix '[' expr ']' | postfix '.' 'new' ref '(' [exprs] ')' [body]
  | postfix '.' ('this' | 'class' | 'super') | (postfix | jtype) '::' [targs] (name | 'new')
primary: name | NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' ref '(' [exprs] ')' [body]
  | 'new' (PRIM | ref) newdims | 'new' (PRIM | ref) dims {dims} init | (PRIM | ref) {dims} '.' 'class'
newdims: '[' expr ']' | newdims '[' expr ']' | newdims '[' ']'
"""

_C = r"""
unit: {ext}
ext: func | decl | ';' | 'asm' '(' strings ')' ';'
func: specs declarator [attrs] {decl} block
decl: specs [inits] [attrs] ';' | 'static_assert' '(' expr1 [',' STR] ')' ';'
specs: {qual} stype {qual}
qual: QUAL | attr
attrs: attr | attrs attr
attr: 'attribute' '(' '(' [exprs] ')' ')'
stype: prims | tname | struct | enum | 'typeof' '(' (expr | typename) ')'
prims: PRIM | prims PRIM | prims QUAL PRIM
tname: ID
struct: ('struct' | 'union') {attr} ([ID] '{' {field} '}' | ID)
field: specs [fielddecls] ';' | ';' | 'static_assert' '(' expr1 [',' STR] ')' ';'
fielddecls: fielddecl {',' fielddecl}
fielddecl: declarator [':' expr1] | ':' expr1
enum: 'enum' {attr} ([ID] '{' enums [','] '}' | ID)
enums: enumitem {',' enumitem}
enumitem: ID ['=' expr1]
inits: init {',' init}
init: declarator [attrs] ['=' initializer]
initializer: expr1 | '{' [values [',']] '}'
values: value {',' value}
value: [designators '='] initializer
designators: designator | designators designator
designator: '.' ID | '[' expr1 ['...' expr1] ']'
declarator: {ptr} direct
ptr: '*' {qual}
direct: dname | '(' {attr} declarator ')' | direct '[' {qual} [expr1] ']' | direct '(' [params] ')'
dname: ID
params: param {',' param} [',' '...'] | '...'
param: specs [declarator | abstract] ['=' initializer]
abstract: ptrs | [ptrs] absdirect
ptrs: ptr | ptrs ptr
absdirect: '(' abstract ')' | '[' [expr1] ']' | '(' [params] ')' | absdirect '[' [expr1] ']' | absdirect '(' [params] ')'
typename: specs [abstract]
block: '{' {stmt} '}'
stmt: block | decl | [expr] ';' | 'if' '(' cond ')' stmt ['else' stmt] | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' forinit [cond] ';' [expr] ')' stmt | 'switch' '(' cond ')' stmt | 'case' expr1 ['...' expr1] ':' stmt | 'default' ':' stmt | ID ':' stmt
  | 'goto' ID ';' | 'break' ';' | 'continue' ';' | 'return' [expr] ';' | 'asm' [QUAL] '(' strings {':' [exprs]} ')' ';'
cond: expr
forinit: decl | [expr] ';'
expr: expr1 {',' expr1}
exprs: expr1 {',' expr1}
expr1: ternary | unary ('=' | ASG) expr1
ternary: binary ['?' [expr] ':' (ternary | unary '=' expr1)]
binary: unary | binary (BIN | CMP | '&&' | '+' | '-' | '*' | '&' | '<' | '>') unary
unary: postfix | (INC | '&' | '*' | '+' | '-' | '!' | '~' | '&&') unary | 'sizeof' unary | 'sizeof' '(' typename ')' | '(' typename ')' unary
postfix: primary | postfix '[' expr ']' | postfix '(' [exprs] ')' | postfix ('.' | '->') member | postfix INC | '(' typename ')' '{' [values [',']] '}'
member: ID
primary: ID | NUM | strings | CHR | '(' expr ')' | '(' block ')' | 'generic' '(' expr1 ',' assoc {',' assoc} ')'
assoc: (typename | 'default') ':' expr1
strings: STR | strings STR
"""

_CPP = r"""
ext: namespace | using | template | 'extern' STR ('{' {ext} '}' | ext) | ctor | [attr2] 'export' ext
namespace: ['inline'] 'namespace' [attr2] [qid] '{' {ext} '}' | 'namespace' ID '=' qid ';'
using: 'using' 'namespace' qid ';' | 'using' ['typename'] qname ';' | 'using' ID '=' typename ';'
template: 'template' '<' [tparams] '>' [requires] (func | decl | ctor | template | using | conceptdecl) | 'template' decl
conceptdecl: 'concept' ID '=' expr1 ';'
requires: 'requires' postfix
tparams: tparam {',' tparam}
tparam: ('typename' | 'class') ['...'] [ID] ['=' typename] | param | specs '...' [ID] | 'template' '<' tparams '>' ('class' | 'typename') [ID]
qid: ID {'::' ID}
qname: ['::'] part | qname '::' ['template'] part
part: ID | ID '<' [targs] '>' | '~' ID | 'operator' operator | 'operator' typename
targs: targ {',' targ} ['...']
targ: typename | expr1 | typename '...'
tname: qname | 'typename' qname | 'auto' | 'decltype' '(' expr ')'
operator: BIN | CMP | ASG | '=' | INC | '+' | '-' | '*' | '&' | '<' | '>' | '!' | '~' | '&&' | '->' | '(' ')' | '[' ']' | ',' | ('new' | 'delete') ['[' ']'] | STR ID
qual: 'const' | 'volatile' | attr2 | 'virtual' | 'explicit' | 'friend' | 'constexpr' | 'mutable' | 'inline' | 'thread_local' | 'extern' | 'explicit' '(' expr1 ')'
attr2: '[' '[' [exprs] ']' ']' | 'alignas' '(' targ ')'
struct: ('class' | 'struct' | 'union') {attr | attr2} ([qname ['final']] [bases] '{' {cmember} '}' | qname)
bases: ':' base {',' base}
base: {'public' | 'private' | 'protected' | 'virtual'} qname ['...']
cmember: ('public' | 'private' | 'protected') ':' | field | func | ctor | template | using | 'friend' decl
field: specs fieldinit {',' fieldinit} ';'
fieldinit: declarator ['=' initializer] | declarator '{' [values [',']] '}' | declarator pure
pure: '=' ('default' | 'delete')
ctor: {qual} qname '(' [params] ')' {suffix} (ctorinit block | block | ';' | pure ';') | {qual} qname '(' [params] ')' {suffix} 'try' ctorinit block catches
ctorinit: ':' meminit {',' meminit}
meminit: qname ('(' [exprs] ')' | '{' [values [',']] '}') ['...']
func: specs declarator '=' ('default' | 'delete') ';' | specs declarator 'try' block catches
suffix: 'const' | 'override' | 'final' | 'noexcept' ['(' expr1 ')'] | '&' | '&&' | '->' typename | 'volatile' | 'throw' '(' [exprs] ')'
direct: direct '(' [params] ')' suffixes | '...' [ID]
suffixes: suffix | suffixes suffix
dname: qname | '[' ID {',' ID} ']'
ptr: '&' {qual} | '&&' {qual} | qname '::' '*'
init: declarator '(' exprs ')' | declarator '{' [values [',']] '}'
enum: 'enum' ['class' | 'struct'] [ID] [':' specs] ['{' [enums [',']] '}']
decl: using | template | struct ';'
stmt: [attr2] try | 'for' '(' [decl] specs declarator ':' initializer ')' stmt | 'if' ['constexpr'] '(' decl cond ')' stmt ['else' stmt] | 'if' 'constexpr' '(' cond ')' stmt ['else' stmt]
  | 'return' braces ';' | 'co_return' [expr] ';'
cond: specs declarator '=' initializer | specs declarator '{' [values] '}'
try: 'try' block catches
catches: catch | catches catch
catch: 'catch' '(' (param | '...') ')' block
braces: '{' [values [',']] '}'
expr1: 'throw' [expr1] | unary ('=' | ASG) braces | 'co_yield' expr1 | expr1 '...'
binary: binary ('>' '>' | '&&' | '<=>') unary
unary: 'new' ['(' exprs ')'] newtype ['(' [exprs] ')' | braces] | ['::'] 'delete' ['[' ']'] unary | 'co_await' unary | 'sizeof' '...' '(' ID ')' | 'noexcept' '(' expr1 ')' | 'alignof' '(' typename ')'
newtype: specs {ptr} {'[' expr1 ']'} | '(' typename ')'
postfix: CAST '<' typename '>' '(' expr ')' | typector ('(' [exprs] ')' | braces) | 'typeid' '(' (typename | expr) ')' | postfix '[' braces ']'
  | postfix '(' braces {',' exprs} ')' | postfix '(' exprs ',' braces ')'
typector: prims | qname | 'typename' qname | 'auto'
member: ['template'] part | qname
primary: qname | 'this' | 'true' | 'false' | 'nullptr' | lambda | 'requires' ['(' [params] ')'] '{' {stmt} '}' | '(' expr1 BIN '...' ')' | '(' '...' BIN expr1 ')'
lambda: '[' [captures] ']' ['<' tparams '>'] ['(' [params] ')'] {suffix | 'mutable' | 'constexpr'} block
captures: capture {',' capture}
capture: '&' | '=' | ['&'] ID ['...'] ['=' expr1] | ['*'] 'this' | '...' ID ['=' expr1]
"""


def c_family(cpp: bool) -> str:
    if not cpp:
        return _C
    text = _C.replace("tname: ID\n", "").replace("dname: ID\n", "").replace("member: ID\n", "")
    return text.replace("primary: ID | NUM", "primary: NUM") + _CPP


RUST = r"""
file: {inner} {item}
inner: '#' '!' '[' trees ']'
attr: '#' '[' trees ']'
tree: TOKEN | '(' [trees] ')' | '[' [trees] ']' | '{' [trees] '}'
trees: tree | trees tree
item: {attr} [vis] plain | {attr} macro ';' | {attr} bracemacro
vis: 'pub' ['(' ('crate' | 'self' | 'super' | 'in' path) ')']
plain: 'use' usetree ';' | 'mod' ID (';' | '{' {inner} {item} '}') | func | struct | enum | ID ID [generics] [where] fields
  | ('const' | 'static' ['mut']) (ID | '_') ':' type ['=' expr] ';' | 'type' ID [generics] [':' bounds] [where] ['=' type] [where] ';'
  | ['unsafe'] 'impl' [generics] ['!'] type ['for' type] [where] '{' {inner} {item} '}'
  | ['unsafe'] 'trait' ID [generics] [':' [bounds]] [where] '{' {inner} {item} '}'
  | ['unsafe'] 'extern' [STR] '{' {item} '}' | 'extern' 'crate' (ID | 'self') ['as' (ID | '_')] ';' | 'macro_rules' '!' ID tree [';']
usetree: [usepath '::'] ('*' | '{' [usetree {',' usetree} [',']] '}') | usepath ['as' (ID | '_')] | '::' usetree
usepath: seg | usepath '::' seg
seg: ID | 'self' | 'super' | 'crate' | 'Self'
func: {'const' | 'async' | 'unsafe' | 'extern' | 'extern' STR} 'fn' ID [generics] '(' [fparams [',']] ')' ['->' type] [where] (block | ';')
fparams: fparam {',' fparam}
fparam: {attr} pattern ':' type | {attr} ['&' [LIFE]] ['mut'] 'self' [':' type] | '...'
generics: '<' [gparam {',' gparam} [',']] '>'
gparam: {attr} LIFE [':' lbounds] | {attr} ID [':' [bounds]] ['=' type] | 'const' ID ':' type ['=' expr0]
lbounds: LIFE {'+' LIFE}
where: 'where' [wpred {',' wpred} [',']]
wpred: LIFE ':' lbounds | ['for' generics] type ':' [bounds]
bounds: bound {'+' bound} ['+']
bound: LIFE | ['?'] ['for' generics] path | '(' ['?'] path ')'
struct: 'struct' ID [generics] ([where] (fields | ';') | '(' [tfields [',']] ')' [where] ';')
fields: '{' [field {',' field} [',']] '}'
field: {attr} [vis] ID ':' type
tfields: tfield {',' tfield}
tfield: {attr} [vis] type
enum: 'enum' ID [generics] [where] '{' [variant {',' variant} [',']] '}'
variant: {attr} ID [fields | '(' [tfields [',']] ')'] ['=' expr]
type: path | '&' [LIFE] ['mut'] type | '&&' [LIFE] ['mut'] type | '*' ('const' | 'mut') type | '[' type [';' expr] ']' | '(' [type {',' type} [',']] ')' | '!' | '_'
  | ['for' generics] ['unsafe'] ['extern' [STR]] 'fn' '(' [ftypes] ')' ['->' type] | ('dyn' | 'impl') bounds | macro
ftypes: ftype {',' ftype} [',']
ftype: [(ID | '_') ':'] type
path: ['::'] pseg | path '::' pseg | '<' type ['as' path] '>' '::' pseg
pseg: seg [targs] | seg '::' targs | seg '(' [type {',' type} [',']] ')' ['->' type]
targs: '<' [targ {',' targ} [',']] '>'
targ: LIFE | type | ID '=' type | ID ':' bounds | NUM | block | '-' NUM
epath: ['::'] eseg | epath '::' eseg | '<' type ['as' path] '>' '::' eseg
eseg: seg | '<' [targ {',' targ} [',']] '>'
block: '{' {inner} {stmt} [bexpr] '}'
bexpr: expr
stmt: ';' | item | {attr} 'let' pattern [':' type] ['=' expr ['else' block]] ';' | {attr} expr ';' | {attr} blockexpr
blockexpr: block | 'unsafe' block | 'async' ['move'] block | 'const' block | if | match | [LIFE ':'] loop
if: 'if' cond block ['else' (if | block)]
cond: expr | 'let' pattern '=' expr | cond '&&' 'let' pattern '=' expr
match: 'match' expr '{' {inner} [arms] '}'
arms: arm | bodyarm | arms ',' | comma arm | blockarms arm | comma bodyarm | blockarms bodyarm
comma: arms ','
blockarms: bodyarm | comma bodyarm | blockarms bodyarm
arm: armhead expr
bodyarm: armhead blockexpr
armhead: {attr} pattern ['if' cond] '=>'
loop: 'loop' block | 'while' cond block | 'for' pattern 'in' expr block
pattern: ['|'] pat {'|' pat}
pat: ['-'] lit | ['ref'] ['mut'] ID ['@' pat] | '_' | '..' | rangeend RANGE [rangeend] | RANGE rangeend | '&' ['mut'] pat | '&&' pat | '(' [pattern {',' pattern} [',']] ')'
  | '[' [pattern {',' pattern} [',']] ']' | path | path '(' [pattern {',' pattern} [',']] ')' | path '{' [fpat {',' fpat} [',']] '}' | macro | rangeend '..'
rangeend: ['-'] lit | path
fpat: {attr} (['ref'] ['mut'] ID | (ID | NUM) ':' pattern | '..')
lit: NUM | STR | CHR | 'true' | 'false'
expr: range | unary ('=' | ASG | '>' CMP) expr | 'return' [expr] | 'break' [LIFE] [expr] | 'continue' [LIFE] | closure | 'yield' [expr]
expr0: lit | '-' lit | block | ID
closure: ['static'] ['async'] ['move'] ('||' | '|' [cparam {',' cparam} [',']] '|') (expr | '->' type block)
cparam: {attr} pat [':' type]
range: binary | [binary] ('..' | RANGE) [binary]
binary: unary | binary (BIN | CMP | '+' | '-' | '*' | '&' | '&&' | '||' | '|' | '<' | '>' | '>' '>') unary | binary 'as' type | binary ('&&' | '||' | BIN | '+' | '-' | '*' | CMP) closure
unary: postfix | ('-' | '!' | '*') unary | ('&' | '&&') ['mut'] unary
postfix: primary | postfix '?' | postfix '.' (ID | NUM | 'await') | postfix '.' ID '::' targs '(' [exprs [',']] ')' | postfix '(' [exprs [',']] ')' | postfix '[' expr ']'
exprs: aexpr {',' aexpr}
aexpr: {attr} expr
primary: lit | epath | '(' [exprs [',']] ')' | '[' [exprs [',']] ']' | '[' expr ';' expr ']' | blockexpr | epath '{' [finits] '}' | macro | bracemacro | '_'
finits: finit {',' finit} [',' ['..' [expr]]] | '..' expr
finit: {attr} (ID | NUM) [':' expr]
macro: path '!' ('(' [trees] ')' | '[' [trees] ']')
bracemacro: path '!' [ID] '{' [trees] '}'
"""
