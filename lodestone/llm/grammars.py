"""Grammars of the six source languages for parsing with derivatives, and the passes that make token classes of tokens.

They describe syntax alone: names, types and reserved words standing where a name is expected are not checked. Reserved
words that are common names (``match``, ``package``, ``export``) may be called like any name.
"""

from __future__ import annotations

import re
from functools import lru_cache

from .derivatives import Grammar
from .lexing import Classes, tokens

_PYTHON = """
file = { stmt | 'NL' } ;
block = 'NL' 'IN' stmt { stmt } 'DE' | simples ;
simples = simple { ';' simple } [ ';' ] 'NL' ;
stmt = simples | compound ;
simple = starlist | targets '=' { targets '=' } rhs | single 'A' rhs | ( single | '(' single ')' ) ':' expr [ '=' rhs ] | yield
  | 'return' [ starlist ] | 'raise' [ expr [ 'from' expr ] ] | 'pass' | 'break' | 'continue'
  | 'import' dotted [ 'as' name ] { ',' dotted [ 'as' name ] }
  | 'from' ( dotted | ( '.' | '...' ) { '.' | '...' } [ dotted ] ) 'import' ( '*' | aliases | '(' aliases [ ',' ] ')' )
  | 'global' name { ',' name } | 'nonlocal' name { ',' name } | 'del' targets | 'assert' expr [ ',' expr ]
  | 'type' name [ tparams ] '=' expr ;
tparams = '[' tparam { ',' tparam } [ ',' ] ']' ;
tparam = [ '*' | '**' ] name [ ':' expr ] [ '=' [ '*' ] expr ] ;
aliases = name [ 'as' name ] { ',' name [ 'as' name ] } ;
rhs = yield | starlist ;
yield = 'yield' [ 'from' expr | starlist ] ;
dotted = name { '.' name } ;
name = 'i' | 'match' | 'case' | 'type' ;
compound = { '@' named 'NL' } [ 'async' ] ( 'def' name [ tparams ] '(' [ params ] ')' [ '->' expr ] ':' block
    | 'for' targets 'in' starlist ':' block [ else ] | 'with' withs ':' block )
  | { '@' named 'NL' } 'class' name [ tparams ] [ '(' [ args ] ')' ] ':' block
  | 'if' named ':' block { 'elif' named ':' block } [ else ] | 'while' named ':' block [ else ]
  | 'try' ':' block ( except { except } [ else ] [ finally ] | finally )
  | 'match' starlist ':' 'NL' 'IN' case { case } 'DE' ;
case = 'case' pattern { ',' pattern } [ ',' ] [ 'if' named ] ':' block ;
pattern = [ '*' ] choice { 'b' choice } [ 'as' name ] ;
choice = operation | '(' pattern { ',' pattern } [ ',' ] ')' | '[' [ pattern { ',' pattern } [ ',' ] ] ']' ;
else = 'else' ':' block ;
finally = 'finally' ':' block ;
except = 'except' [ '*' ] [ starlist [ 'as' name ] ] ':' block ;
withs = with { ',' with } | '(' with { ',' with } [ ',' ] ')' ;
with = expr [ 'as' target ] ;
targets = target { ',' target } [ ',' ] ;
target = [ '*' ] ( single | '(' [ yield | items ] ')' | '[' [ items ] ']' ) ;
single = name | atom { trailer } ( '.' name | '[' slices ']' ) ;
trailer = '.' name | '(' [ args ] ')' | '[' slices ']' ;
params = plain pmore | plain '=' expr dmore | pstar | pdstar ;
plain = name [ ':' expr ] ;
pmore = [ ',' [ plain pmore | '/' pmore | plain '=' expr dmore | pstar | pdstar ] ] ;
dmore = [ ',' [ plain '=' expr dmore | '/' dmore | pstar | pdstar ] ] ;
pstar = '*' ( name [ ':' [ '*' ] expr ] smore | ',' plain [ '=' expr ] smore ) ;
smore = [ ',' [ plain [ '=' expr ] smore | pdstar ] ] ;
pdstar = '**' plain [ ',' ] ;
lparams = name lpmore | name '=' expr ldmore | lstar | ldstar ;
lpmore = [ ',' [ name lpmore | '/' lpmore | name '=' expr ldmore | lstar | ldstar ] ] ;
ldmore = [ ',' [ name '=' expr ldmore | '/' ldmore | lstar | ldstar ] ] ;
lstar = '*' ( name lsmore | ',' name [ '=' expr ] lsmore ) ;
lsmore = [ ',' [ name [ '=' expr ] lsmore | ldstar ] ] ;
ldstar = '**' name [ ',' ] ;
starlist = star { ',' star } [ ',' ] ;
star = '*' expr | named ;
named = expr [ ':=' expr ] ;
expr = 'lambda' [ lparams ] ':' expr | operation [ 'if' operation 'else' expr ] ;
operation = { 'not' } sum { ( 'and' | 'or' ) { 'not' } sum } ;
sum = factor { binary factor } ;
binary = 'in' | 'not' 'in' | 'is' [ 'not' ] | 'b' | '/' | '-' | '+' | '*' | '**' | '@' ;
factor = { '-' | '+' | 'u' | 'await' } primary ;
primary = atom { trailer } ;
atom = name | 'k' | 'n' | 's' { 's' } | '...' | '(' [ yield | items ] ')' | '[' [ items ] ']' | '{' [ entries ] '}' ;
items = star ( comp | { ',' star } [ ',' ] ) ;
entries = star ( comp | { ',' star } [ ',' ] ) | entry ( comp | { ',' entry } [ ',' ] ) ;
entry = expr ':' expr | '**' expr ;
comp = [ 'async' ] 'for' targets 'in' operation { 'if' operation | [ 'async' ] 'for' targets 'in' operation } ;
args = named comp | named amore | '*' expr amore | name '=' expr kmore | '**' expr kkmore ;
amore = [ ',' [ named amore | '*' expr amore | name '=' expr kmore | '**' expr kkmore ] ] ;
kmore = [ ',' [ name '=' expr kmore | '*' expr kmore | '**' expr kkmore ] ] ;
kkmore = [ ',' [ name '=' expr kkmore | '**' expr kkmore ] ] ;
slices = slice { ',' slice } [ ',' ] ;
slice = star | [ expr ] ':' [ expr ] [ ':' [ expr ] ] ;
"""

# T(...) stands for TypeScript only; B0 rules are the B rules of expressions that may not begin with an object.
_ECMA = """
file = { item } ;
item = 'import' ( 's' | [T('type')] importing 'from' 's' ) [ 'with' object ] ';' T( | 'import' [ 'type' ] bind '=' expr ';' | 'export' '=' expr ';' | 'export' 'as' bind bind ';' )
  | 'export' ( 'default' ( function | class | expr ';' ) | '*' [ 'as' name ] 'from' 's' ';' | [T('type')] braces [ 'from' 's' ] ';' | declaration )
  | stmt ;
importing = 'i' [ ',' ( '*' 'as' name | braces ) ] | '*' 'as' name | braces ;
braces = '{' [ spec { ',' spec } [ ',' ] ] '}' ;
spec = [T('type')] ( name | 's' ) [ 'as' ( name | 's' ) ] ;
declaration = variables ';' | function | { 'D' [ '(' [ args ] ')' ] { '.' name } } class T( | interface | { 'm' } class | 'type' bind [ tparams ] '=' type ';' | [ 'const' ] 'enum' bind object | ( 'namespace' | 'module' ) ( bind { '.' name } | 's' ) block | 'declare' declaration | 'declare' 'const' variable { ',' variable } ';' | 'declare' bind block | 'declare' 'function' bind signature ';' ) ;
variables = ( 'let' | 'var' ) variable { ',' variable } | 'const' constant { ',' constant } ;
constant = binding [T('!')] T([ ':' type ]) '=' expr ;
variable = binding [T('!')] T([ ':' type ]) [ '=' expr ] ;
binding = bind | array | object ;
bind = 'i' | 'm' | 'async' | 'of' | 'as' | 'from' T( | 'type' | 'namespace' | 'declare' | 'is' | 'module' | 'keyof' | 'infer' | 'satisfies' | 'asserts' | 'unique' ) ;
name = bind | 'await' | 'break' | 'case' | 'catch' | 'class' | 'const' | 'continue' | 'debugger' | 'default' | 'delete' | 'do' | 'else' | 'export'
  | 'extends' | 'finally' | 'for' | 'function' | 'if' | 'import' | 'in' | 'instanceof' | 'let' | 'new' | 'return' | 'super' | 'switch' | 'this'
  | 'throw' | 'try' | 'typeof' | 'var' | 'void' | 'while' | 'yield' T( | 'interface' | 'enum' | 'implements' ) ;
block = '{' { item } '}' ;
stmt = block | ';' | declaration | bind ':' stmt | exprs0 ';' | 'debugger' ';'
  | 'if' '(' exprs ')' stmt [ 'else' stmt ] | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' [ ';' ]
  | 'for' [ 'await' ] '(' ( [ variables | exprs ] ';' [ exprs ] ';' [ exprs ] | ( ( 'const' | 'let' | 'var' ) binding | operation ) ( 'of' | 'in' ) exprs ) ')' stmt
  | 'return' [ exprs ] ';' | 'throw' exprs ';' | ( 'break' | 'continue' ) [ bind ] ';'
  | 'switch' '(' exprs ')' '{' { ( 'case' exprs | 'default' ) ':' { item } } '}'
  | 'try' block ( 'catch' [ '(' binding T([ ':' type ]) ')' ] block [ 'finally' block ] | 'finally' block ) ;
function = [ 'async' ] 'function' [ '*' ] [ bind ] signature ( block T( | ';' ) ) ;
signature = T([ tparams ]) '(' [ params ] ')' T([ ':' type ]) ;
params = param { ',' param } [ ',' ] ;
param = { 'D' [ '(' [ args ] ')' ] } T({ 'm' }) [ '...' ] ( binding | 'this' ) T([ '?' ] [ ':' type ]) [ '=' expr ] ;
class = 'class' [ bind ] T([ tparams ]) [ 'extends' postfix T([ typeargs ]) ] T([ 'implements' type { ',' type } ]) '{' { member } '}' ;
member = ';' | 'm' block | { 'D' [ '(' [ args ] ')' ] } { 'm' | 'async' T( | 'declare' ) } [ '*' ] key T([ '?' | '!' ]) ( signature ( block T( | ';' ) ) | T([ ':' type ]) [ '=' expr ] ';' ) ;
key = name | 's' | 'n' | '[' expr ']' ;
exprs = expr { ',' expr } ;
expr = ( place | object ) settled | value unsettled | prefix { prefix T( | '<' type '>' ) } postfix [ '++' | '--' ] rest T( | '<' type '>' unary rest ) | arrow | 'yield' [ '*' ] [ expr ] ;
exprs0 = expr0 { ',' expr } ;
expr0 = place settled | value0 unsettled | prefix { prefix T( | '<' type '>' ) } postfix [ '++' | '--' ] rest T( | '<' type '>' unary rest ) | arrow | 'yield' [ '*' ] [ expr ] ;
settled = ( '=' | 'A' ) expr | unsettled ;
unsettled = member1 settled | call unsettled | [ '++' | '--' ] rest ;
rest = { binary unary } [ '?' expr ':' expr ] ;
member1 = ( '.' | '?.' ) name | '?.' '[' exprs ']' | '[' exprs ']' T( | '!' | 'as' type ) ;
call = '?.' '(' [ args ] ')' | '(' [ args ] ')' | 't' T( | ( 'as' 'const' | 'satisfies' ( type | 'const' ) ) | typeargs '(' [ args ] ')' ) ;
arrow = [ 'async' ] ( bind | signature ) '=>' ( expr0 | block ) ;
operation = unary { binary unary } ;
operation0 = unary0 { binary unary } ;
binary = 'b' | '+' | '-' | '*' | '|' | '&' | '||' | '&&' | '**' | '<' | '>' [ '>' [ '>' ] ] [ '=' ] | 'in' | 'instanceof' ;
prefix = '!' | '-' | '+' | 'u' | 'typeof' | 'void' | 'delete' | 'await' | '++' | '--' ;
unary = { prefix T( | '<' type '>' ) } postfix [ '++' | '--' ] ;
unary0 = prefix unary T( | '<' type '>' unary ) | postfix0 [ '++' | '--' ] ;
postfix = primary { trailer } ;
postfix0 = primary0 { trailer } ;
trailer = member1 | call ;
primary = place | object | value ;
primary0 = place | value0 ;
value = value0 | function | class ;
place = bind | array | '(' exprs ')' ;
value0 = 'n' | 's' | 't' | 'r' | 'this' | 'super' | 'new' ( '.' name | callee [ '(' [ args ] ')' ] ) | 'import' ( '(' args ')' | '.' name ) | 'export' '(' [ args ] ')' ;
callee = primary { ( '.' | '?.' ) name | '[' exprs ']' } T([ typeargs ]) ;
array = '[' { ',' } [ element { ',' { ',' } element } { ',' } ] ']' ;
element = [ '...' ] expr ;
object = '{' [ property { ',' property } [ ',' ] ] '}' ;
property = '...' expr | key ':' expr | bind [ '=' expr ] | { 'm' | 'async' } [ '*' ] key signature block ;
args = element { ',' element } [ ',' ] ;
"""
_TYPES = """
interface = 'interface' bind [ tparams ] [ 'extends' type { ',' type } ] shape ;
element2 = [ '...' ] [ bind [ '?' ] ':' ] type [ '?' ] ;
shape = '{' { signed ( ';' | ',' ) } [ signed ] '}' ;
signed = { 'm' } key [ '?' ] [ ':' type ] | { 'm' } key [ '?' ] signature | [ 'new' ] signature | { 'm' | '-' | '+' } '[' bind ( ':' | 'in' ) type ']' [ [ '-' | '+' ] '?' ] ':' type ;
tparams = '<' tparam { ',' tparam } [ ',' ] '>' ;
tparam = [ 'const' ] bind [ 'extends' type ] [ '=' type ] ;
typeargs = '<' type { ',' type } '>' ;
type = [ '|' | '&' ] unit { ( '|' | '&' ) unit } [ 'extends' type '?' type ':' type ] | [ 'new' ] [ tparams ] '(' [ params ] ')' '=>' type ;
unit = { 'keyof' | 'typeof' | 'infer' | 'm' | 'unique' } named { '[' [ type ] ']' } ;
named = ( bind | 'this' ) { '.' name } [ typeargs ] | 's' | 't' | [ '-' ] 'n' | 'void' | '(' type ')' | shape | '[' [ element2 { ',' element2 } [ ',' ] ] ']'
  | [ 'asserts' ] ( bind | 'this' ) 'is' type | 'asserts' bind | 'import' '(' 's' ')' { '.' name } [ typeargs ] ;
"""

_JAVA = """
file = [ { annotation } 'package' dotted ';' ] { 'import' [ 'm' ] dotted [ '.' '*' ] ';' | ';' } { typedecl | ';' } | { annotation } [ name ] name dotted '{' { name [ 'm' | name ] dotted [ name dotted { ',' dotted } ] ';' } '}' ;
name = 'i' | 'record' | 'permits' | 'yield' | 'package' ;
dotted = name { '.' name } ;
annotation = '@' dotted [ '(' [ annarg { ',' annarg } [ ',' ] ] ')' ] ;
annarg = [ name '=' ] ( expr | annotation | braces ) ;
braces = '{' [ ( expr | annotation | braces ) { ',' ( expr | annotation | braces ) } ] [ ',' ] '}' ;
mods = { 'm' | 'default' | 'synchronized' | name '-' 'm' | annotation } ;
typedecl = mods typebody ;
typebody = 'class' name [ tparams ] [ 'extends' type ] [ 'implements' types ] [ 'permits' types ] body
  | 'interface' name [ tparams ] [ 'extends' types ] [ 'permits' types ] body | '@' 'interface' name body
  | 'enum' name [ 'implements' types ] '{' [ constant { ',' constant } ] [ ',' ] [ ';' { member } ] '}'
  | 'record' name [ tparams ] '(' [ params ] ')' [ 'implements' types ] body ;
constant = { annotation } name [ '(' [ args ] ')' ] [ body ] ;
body = '{' { member } '}' ;
member = ';' | block | mods ( block | typebody | [ tparams ] ( type name '(' [ params ] ')' { '[' ']' } [ 'throws' types ] ( block | [ 'default' annarg ] ';' )
  | name '(' [ params ] ')' [ 'throws' types ] block | name block ) | type declarators ';' ) ;
tparams = '<' [ annotation ] name [ 'extends' type { '&' type } ] { ',' name [ 'extends' type { '&' type } ] } '>' ;
types = type { ',' type } ;
type = { annotation } ( 'p' | name [ targs ] { '.' name [ targs ] } ) { '[' ']' } ;
targs = '<' [ targ { ',' targ } ] '>' ;
targ = type | '?' [ ( 'extends' | 'super' ) type ] ;
params = param { ',' param } ;
param = { 'm' | annotation } type [ '...' ] ( name | 'this' ) { '[' ']' } ;
declarators = declarator { ',' declarator } ;
declarator = name { '[' ']' } [ '=' init ] ;
init = expr | '{' [ init { ',' init } ] [ ',' ] '}' ;
block = '{' { stmt } '}' ;
stmt = block | ';' | { 'm' | annotation } ( type declarators ';' | typebody ) | effect ';' | name ':' stmt
  | 'if' '(' expr ')' stmt [ 'else' stmt ] | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';'
  | 'for' '(' ( [ { 'm' | annotation } type declarators | effect { ',' effect } ] ';' [ expr ] ';' [ effect { ',' effect } ] | { 'm' | annotation } type name ':' expr ) ')' stmt
  | 'try' [ '(' resource { ';' resource } [ ';' ] ')' ] block { 'catch' '(' { 'm' | annotation } type { 'b' type } name ')' block } [ 'finally' block ]
  | switch | 'return' [ expr ] ';' | 'throw' expr ';' | ( 'break' | 'continue' ) [ name ] ';' | 'yield' expr ';'
  | 'synchronized' '(' expr ')' block | 'assert' expr [ ':' expr ] ';' ;
resource = { 'm' } type name '=' expr | expr ;
switch = 'switch' '(' expr ')' '{' { ( 'case' label { ',' label } [ 'if' expr ] | 'default' ) ( ':' { stmt } | '->' ( block | expr ';' | 'throw' expr ';' ) ) } '}' ;
label = operation [ name ] [ name expr ] | 'default' ;
expr = name settled | value unsettled | prefix { prefix } postfix { '++' | '--' } rest | '(' name ')' ( '=' | 'A' ) expr | lambda ;
settled = ( '=' | 'A' | '>' '>' [ '>' ] '=' ) expr | unsettled ;
unsettled = ( '.' name | '[' expr ']' ) settled | call unsettled | { '++' | '--' } rest ;
rest = { binary unary | 'instanceof' [ 'm' ] type [ name | '(' [ params ] ')' ] } [ '?' expr ':' expr ] ;
call = '.' ( [ targs ] ( name | 'super' ) '(' [ args ] ')' | 'super' | 'class' | 'this' | 'new' creator ) | '::' ( name | 'new' ) ;
invocation = '.' ( [ targs ] ( name | 'super' ) '(' [ args ] ')' | 'new' creator ) ;
effect = ( '++' | '--' ) unary | '(' name ')' ( '=' | 'A' ) expr | name placed | ( name | 'this' | 'super' ) '(' [ args ] ')' called | 'new' creator called | ( 'n' | 's' | 'this' | 'super' | '(' ( expr | lambda ) ')' ) unplaced | switch | name [ targs ] '.' 'class' unplaced ;
placed = ( '=' | 'A' | '>' '>' [ '>' ] '=' ) expr | '++' | '--' | unplaced ;
called = [ unplaced ] ;
unplaced = ( '.' name | '[' expr ']' ) placed | invocation called | '.' ( 'this' | 'super' | 'class' ) unplaced ;
lambda = ( name | '(' [ name { ',' name } | params ] ')' ) '->' ( expr | block ) ;
operation = unary { binary unary | 'instanceof' [ 'm' ] type [ name | '(' [ params ] ')' ] } ;
binary = 'b' | '*' | '+' | '-' | '&' | '<' | '>' [ '>' [ '>' ] ] [ '=' ] ;
prefix = 'u' | '+' | '-' | '++' | '--' | '(' type { '&' type } ')' ;
unary = { prefix } postfix { '++' | '--' } ;
postfix = primary { trailer } ;
trailer = '.' ( [ targs ] ( name | 'super' ) [ '(' [ args ] ')' ] | 'class' | 'this' | 'new' creator ) | '[' expr ']' | '::' ( name | 'new' ) ;
primary = name | value ;
value = name '(' [ args ] ')' | 'n' | 's' | ( 'this' | 'super' ) [ '(' [ args ] ')' ] | '(' expr ')' | '(' lambda ')' | 'new' creator | switch | type ( '::' ( name | 'new' ) | '.' 'class' ) ;
creator = { annotation } ( 'p' | name [ targs ] { '.' name [ targs ] } ) ( '(' [ args ] ')' [ body ] | '[' expr ']' { '[' [ expr ] ']' } | '[' ']' { '[' ']' } '{' [ init { ',' init } ] [ ',' ] '}' ) ;
args = expr { ',' expr } ;
"""

# The rules of expressions are made twice: those ending in C leave out composite (Go) or struct (Rust) literals.
_GO = """
file = { ';' } [ 'package' name ';' { 'import' imports ';' } { top ';' } ] ;
name = 'i' | 'package' ;
imports = spec | '(' { spec ';' } [ spec ] ')' ;
spec = [ name | '.' ] 's' ;
top = 'func' [ '(' name [ type ] ')' | '(' '*' type ')' ] name [ tparams ] sig [ block ] | 'func' '(' name '*' type ')' name sig [ block ] | decl | ;
decl = ( 'var' | 'const' ) ( var | '(' { var ';' } [ var ] ')' ) | 'type' ( typespec | '(' { typespec ';' } [ typespec ] ')' ) ;
var = name { ',' name } [ type ] [ '=' exprs ] ;
typespec = name [ tparams ] [ '=' ] type ;
tparams = '[' name { ',' name } constraint { ',' name { ',' name } constraint } ']' ;
constraint = [ '~' ] type { 'b' [ '~' ] type } ;
sig = '(' [ params ] ')' [ type | '(' [ params ] ')' ] ;
params = param { ',' param } [ ',' ] ;
param = [ name ] [ '...' ] type ;
type = name [ '.' name ] [ '[' type { ',' type } ']' ] | '*' type | '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type | 'chan' [ '<-' ] type | '<-' 'chan' type
  | 'func' sig | 'struct' '{' { field ';' } [ field ] '}' | 'interface' '{' { method ';' } [ method ] '}' | '(' type ')' ;
field = ( name { ',' name } type | [ '*' ] name [ '.' name ] ) [ 's' ] ;
method = name sig | constraint ;
block = '{' stmts '}' ;
stmts = [ stmt ] { ';' [ stmt ] } ;
stmt = decl | name ':' [ stmt ] | simple | 'go' expr | 'defer' expr | 'return' [ exprs ] | ( 'break' | 'continue' | 'goto' ) [ name ] | 'fallthrough' | block | if
  | 'for' ( block | [ simpleC ] ';' [ exprC ] ';' [ simpleC ] block | exprC block | [ exprsC ( ':=' | '=' ) ] 'range' exprC block )
  | 'switch' [ [ simpleC ] ';' ] [ simpleC | name ':=' exprC ] '{' { ( 'case' ( exprs | type { ',' type } ) | 'default' ) ':' stmts } '}'
  | 'select' '{' { ( 'case' simple | 'default' ) ':' stmts } '}' ;
if = 'if' [ [ simpleC ] ';' ] exprC block [ 'else' ( if | block ) ] ;
simple = exprs [ ( ':=' | '=' | 'A' ) exprs | '++' | '--' | '<-' expr ] ;
exprs = expr { ',' expr } ;
expr = unary { binary unary } ;
unary = { 'u' | '+' | '-' | '*' | '&' | '^' | '<-' } postfix ;
postfix = primary { trailer | literal } ;
simpleC = exprsC [ ( ':=' | '=' | 'A' ) exprsC | '++' | '--' | '<-' exprC ] ;
exprsC = exprC { ',' exprC } ;
exprC = unaryC { binary unaryC } ;
unaryC = { 'u' | '+' | '-' | '*' | '&' | '^' | '<-' } postfixC ;
postfixC = primary { trailer } ;
binary = 'b' | '+' | '-' | '*' | '&' | '^' ;
trailer = '.' ( name | '(' ( type | 'type' ) ')' ) | '[' ( expr { ',' expr } | [ expr ] ':' [ expr ] [ ':' expr ] ) ']' | '(' [ arg { ',' arg } [ '...' ] [ ',' ] ] ')' ;
arg = expr | type ;
primary = name | 'n' | 's' | '(' ( expr | type ) ')' | 'func' sig block | ( '[' [ expr | '...' ] ']' type | 'map' '[' type ']' type | 'struct' '{' { field ';' } [ field ] '}' ) ( literal | '(' [ expr ] ')' ) ;
literal = '{' [ keyed { ',' keyed } [ ',' ] ] '}' ;
keyed = [ ( expr | literal ) ':' ] ( expr | literal ) ;
"""

_RUST = """
file = { item } ;
attrs = { '#' [ '!' ] '[' trees ']' } ;
trees = { tree } ;
tree = '(' trees ')' | '[' trees ']' | '{' trees '}' | any ;
item = attrs [ vis ] ( 'use' usetree ';' | 'mod' 'i' ( ';' | '{' { item } '}' ) | { 'const' | 'async' | 'unsafe' | 'extern' [ 's' ] } 'fn' name generics '(' [ selfs ] ')' [ '->' type ] where ( block | ';' )
  | 'struct' 'i' generics ( where '{' [ field { ',' field } [ ',' ] ] '}' | '(' [ tfield { ',' tfield } [ ',' ] ] ')' where ';' | ';' )
  | 'union' 'i' generics where '{' [ field { ',' field } [ ',' ] ] '}' | 'enum' 'i' generics where '{' [ variant { ',' variant } [ ',' ] ] '}' | [ 'unsafe' ] 'impl' generics [ '!' ] type [ 'for' type ] where '{' { item } '}'
  | [ 'unsafe' ] 'trait' 'i' generics [ ':' bounds ] where '{' { item } '}' | ( 'const' | 'static' [ 'mut' ] ) ( name | '_' ) ':' type [ '=' expr ] ';'
  | 'type' 'i' generics [ ':' bounds ] where [ '=' type ] ';' | 'extern' 'crate' ( 'i' | 'self' ) [ 'as' ( 'i' | '_' ) ] ';' | [ 'unsafe' ] 'extern' [ 's' ] '{' { item } '}' ) | macroitem | attrs '#' ;
name = 'i' | 'union' | 'match' ;
macroitem = attrs path '!' [ 'i' ] ( '(' trees ')' ';' | '[' trees ']' ';' | '{' trees '}' ) ;
vis = 'pub' [ '(' [ 'in' ] path ')' ] ;
usetree = [ '::' ] ( useseg { '::' useseg } [ 'as' ( 'i' | '_' ) ] ) ;
useseg = 'i' | 'crate' | 'self' | 'super' | '*' | '{' [ usetree { ',' usetree } [ ',' ] ] '}' ;
generics = [ '<' [ generic { ',' generic } [ ',' ] ] '>' ] ;
generic = attrs ( 'l' [ ':' 'l' { '+' 'l' } ] | 'const' 'i' ':' type [ '=' expr ] | 'i' [ ':' [ bounds ] ] [ '=' type ] ) ;
bounds = bound { '+' bound } ;
bound = 'l' | 'use' '<' [ ( 'l' | 'i' ) { ',' ( 'l' | 'i' ) } ] '>' | [ '?' ] [ 'for' '<' 'l' { ',' 'l' } '>' ] path | '(' bound ')' ;
where = [ 'where' [ wherepart { ',' wherepart } [ ',' ] ] ] ;
wherepart = ( 'l' | [ 'for' '<' 'l' { ',' 'l' } '>' ] type ) ':' [ bounds ] ;
selfs = ( [ '&' [ 'l' ] ] [ 'mut' ] 'self' [ ':' type ] | param ) { ',' param } [ ',' ] ;
param = attrs pat ':' type | attrs type | attrs [ pat ':' ] '...' ;
field = attrs [ vis ] 'i' ':' type ;
tfield = attrs [ vis ] type ;
variant = attrs 'i' [ '{' [ field { ',' field } [ ',' ] ] '}' | '(' [ tfield { ',' tfield } [ ',' ] ] ')' ] [ '=' expr ] ;
type = path | ( '&' | '&&' ) [ 'l' ] [ 'mut' ] type | '*' ( 'const' | 'mut' ) type | '(' [ type { ',' type } [ ',' ] ] ')' | '[' type [ ';' expr ] ']' | '!' | '_'
  | ( 'dyn' | 'impl' ) bounds | [ 'unsafe' ] [ 'extern' [ 's' ] ] 'fn' '(' [ fnparam { ',' fnparam } [ ',' ] ] ')' [ '->' type ] | 'for' '<' [ 'l' { ',' 'l' } ] '>' type | '<' type [ 'as' type ] '>' '::' path | path '!' tree ;
fnparam = attrs [ ( 'i' | '_' ) ':' ] type | '...' ;
path = [ '::' ] segment { '::' segment } ;
segment = ( name | 'crate' | 'self' | 'super' ) [ [ '::' ] targs | '(' [ type { ',' type } ] ')' [ '->' type ] ] ;
targs = '<' [ targ { ',' targ } [ ',' ] ] '>' ;
targ = 'l' | type | 'i' '=' type | 'n' | block ;
block = '{' { stmt } [ attrs expr ] '}' ;
stmt = ';' | item | attrs ( 'let' pat [ ':' type ] [ '=' expr [ 'else' block ] ] ';' | expr ';' | blocklike ) ;
blocklike = [ 'l' ':' ] ( 'loop' block | 'while' [ 'let' pat '=' ] exprC block | 'for' pat 'in' exprC block ) | if | 'match' exprC arms | [ 'unsafe' | 'async' [ 'move' ] | 'const' ] block | 'l' ':' block ;
if = 'if' [ 'let' pat '=' ] exprC block [ 'else' ( if | block ) ] ;
arms = '{' { attrs pat [ 'if' expr ] '=>' ( expr ',' | blocklike ) } [ attrs pat [ 'if' expr ] '=>' expr ] '}' ;
pat = [ '|' ] pat1 { '|' pat1 } ;
pat1 = ( '&' | '&&' ) [ 'mut' ] pat1 | [ 'ref' ] [ 'mut' ] 'i' [ '@' pat1 ] | '_' | '..' | [ '-' ] ( 'n' | 's' ) [ ( '..=' | '..' ) [ [ '-' ] ( 'n' | 's' ) ] ] | '..=' ( 'n' | 's' )
  | path [ '(' [ pat { ',' pat } [ ',' ] ] ')' | '{' [ patfield { ',' patfield } [ ',' ] ] '}' ] | '(' [ pat { ',' pat } [ ',' ] ] ')' | '[' [ pat { ',' pat } [ ',' ] ] ']' ;
patfield = '..' | attrs [ 'ref' ] [ 'mut' ] 'i' | attrs ( 'i' | 'n' ) ':' pat ;
expr = range [ ( '=' | 'A' | '>' '>' '=' | '<' 'b' ) expr ] | closure | jump ;
jump = 'return' [ expr ] | 'break' [ 'l' ] [ expr ] | 'continue' [ 'l' ] ;
closure = [ 'async' ] [ 'move' ] ( '||' | '|' [ cparam { ',' cparam } [ ',' ] ] '|' ) ( expr | '->' type block ) ;
cparam = pat1 [ ':' type ] ;
range = operation [ ( '..' | '..=' ) [ operation ] ] | ( '..' | '..=' ) [ operation ] ;
operation = unary { binary unary } ;
unary = { '-' | '!' | '*' | ( '&' | '&&' ) [ 'mut' ] } ( postfix | closure | jump ) ;
postfix = primary { trailer } ;
primary = primaryC | path '{' [ init { ',' init } [ ',' ] ] [ '..' [ expr ] ] '}' ;
exprC = rangeC [ ( '=' | 'A' ) exprC ] | closure ;
rangeC = operationC [ ( '..' | '..=' ) [ operationC ] ] | ( '..' | '..=' ) [ operationC ] ;
operationC = unaryC { binary unaryC | '&&' 'let' pat '=' unaryC } ;
unaryC = { '-' | '!' | '*' | ( '&' | '&&' ) [ 'mut' ] } postfixC ;
postfixC = primaryC { trailer } ;
binary = 'b' | '+' | '-' | '*' | '|' | '&' | '||' | '&&' | '<' [ '<' ] | '>' [ '>' ] [ '=' ] ;
trailer = '?' | '.' ( ( 'i' | 'union' ) [ '::' targs ] | 'n' | 'await' | 'match' ) | '(' [ args ] ')' | '[' expr ']' | 'as' type ;
primaryC = 'n' | 's' | path | '<' type [ 'as' type ] '>' '::' path | path '!' ( '(' trees ')' | '[' trees ']' | '{' trees '}' ) | '(' [ expr { ',' expr } [ ',' ] ] ')' | '[' [ expr ( ';' expr | { ',' expr } [ ',' ] ) ] ']' | blocklike ;
init = attrs ( 'i' | 'n' ) [ ':' expr ] | '..' expr ;
args = attrs expr { ',' attrs expr } [ ',' ] ;
"""


def _ecma(types: bool) -> str:
    out, k = [], 0
    while (at := _ECMA.find("T(", k)) >= 0:
        depth, end = 1, at + 2
        while depth:
            c = _ECMA[end]
            if c == "'":
                end = _ECMA.index("'", end + 1)
            depth += (c == "(") - (c == ")")
            end += 1
        out += [_ECMA[k:at], _ECMA[at + 2 : end - 1] if types else ""]
        k = end
    return ("".join(out) + _ECMA[k:]).replace("[]", "") + (_TYPES if types else "")


def _rust() -> str:
    words = Classes("rust")
    every = ({*words.fixed.values()} | {*"ilns<>,;:.?=+-*&|!@#$~"} | {"...", "->", "=>", "::", "..", "..=", "||", "&&", "_"}) - {""}
    return _RUST + "any = " + " | ".join(f"'{c}'" for c in sorted(every)) + " ;"


_TEXTS = {"python": _PYTHON, "java": _JAVA, "go": _GO, "javascript": _ecma(False), "typescript": _ecma(True)}


@lru_cache(None)
def grammar(language: str) -> Grammar:
    """The grammar of a language with its memo; one of each per Python worker."""
    return Grammar(_rust() if language == "rust" else _TEXTS[language], "file")


@lru_cache(None)
def memo(language: str) -> Classes:
    return Classes(language)


#: Go ends a statement at a line end after these classes.
_GO_ENDS = {"i", "n", "s", ")", "]", "}", "++", "--", "break", "continue", "fallthrough", "return", "package"}


def classes(language: str, toks: list[str]) -> tuple[list[str], list[int] | None]:
    """Grammar classes of tokens, layout made explicit; with them, where it isn't one to one, the token index of each."""
    get = memo(language).__getitem__
    raw = [get(t) for t in toks]
    if language == "python":
        return _python_layout(toks, raw)
    if language == "go":
        out, at, last = [], [], ";"
        for k, c in enumerate(raw):
            if c == "\n":
                if last in _GO_ENDS:
                    out.append(";")
                    at.append(k)
                    last = ";"
            elif c:
                out.append(c)
                at.append(k)
                last = c
            elif last in _GO_ENDS and "\n" in toks[k]:
                out.append(";")
                at.append(k)
                last = ";"
        if last in _GO_ENDS:
            out.append(";")
            at.append(len(toks))
        return out, at
    return raw, None


def _python_layout(toks: list[str], raw: list[str]) -> tuple[list[str], list[int]]:
    """Line ends become NL, changes of indentation IN and DE; both vanish within brackets. An indentation that matches no
    outer one gives X."""
    out, at, levels, depth = [], [], [(0, 0)], 0
    started = False
    for k, c in enumerate(raw):
        if c in ("(", "[", "{"):
            depth += 1
        elif c in (")", "]", "}"):
            depth = max(0, depth - 1)
        elif not c:
            continue
        elif c[0] in "\n \t" or c[0] == "#":
            if depth or k == len(raw) - 1:
                continue
            if k + 1 < len(raw) and not raw[k + 1]:  # a comment or a joined line follows
                continue
            t = toks[k]
            line = t[t.rfind("\n") + 1 :] if "\n" in t else t
            width = len(line.expandtabs(8)), len(line)  # tabs may not decide how two lines compare
            if started:
                out.append("NL")
                at.append(k)
            elif not started and width[0] == 0:
                continue
            if width[0] > levels[-1][0]:
                if width[1] <= levels[-1][1]:
                    out.append("X")
                    at.append(k)
                levels.append(width)
                out.append("IN")
                at.append(k)
            else:
                while width[0] < levels[-1][0]:
                    levels.pop()
                    out.append("DE")
                    at.append(k)
                if width != levels[-1]:
                    out.append("X")
                    at.append(k)
            started = True
            continue
        started = True
        out.append(c)
        at.append(k)
    if depth:  # the text ends within brackets: it was cut off
        return out, at
    if started and out and out[-1] != "NL":
        out.append("NL")
        at.append(len(toks))
    out += ["DE"] * (len(levels) - 1)
    at += [len(toks)] * (len(levels) - 1)
    return out, at


#: In JavaScript a slash begins a regular expression after these classes.
_BEFORE_REGEX = set("( , = : [ ! & | ? { } ; + - * A b < > u".split()) | {"=>", "&&", "||", "return", "typeof", "case", "in", "of", "..."}


_INDENTED = re.compile(r"[ \t]+[^\s#\\]")


def parse(language: str, text: str) -> tuple[str, int]:
    """``("ok", -1)``, ``("broken", index of the failing token)`` or ``("truncated", number of tokens)``."""
    toks = tokens(language, text)
    if language == "python" and _INDENTED.match(text):
        return "broken", 0
    g = grammar(language)
    cls, at = classes(language, toks)
    if language in ("javascript", "typescript"):
        return _ecma_parse(g, toks, cls)
    if at is None:
        cls = [c for c in cls if c]
    s = g.run(cls)
    if s is g.empty:
        k = g.failing(cls)
        return "broken", (at[k] if at else k)
    return ("ok", -1) if g.nullable(s) else ("truncated", len(toks))


def _ecma_parse(g: Grammar, toks: list[str], raw: list[str]) -> tuple[str, int]:
    """Without its line ends first; only where that fails, token by token with the semicolons that line ends, closing
    braces and the end of the file stand for."""
    s = g.run([c for c in raw if c and c != "\n"])
    if s is not g.empty and g.nullable(s):
        return "ok", -1
    s, fresh, prev, k, n = g.start, False, ";", 0, len(raw)
    while k < n:
        c = raw[k]
        if c == "\n" or not c:
            fresh = fresh or "\n" in toks[k]
            k += 1
            continue
        if c == "b" and toks[k] == "/" and (prev in _BEFORE_REGEX or prev == ")" and s[c] is g.empty):
            end, bracket = k + 1, False
            while end < n and raw[end] != "\n" and (bracket or toks[end] != "/"):
                bracket = toks[end] == "[" or bracket and toks[end] != "]"
                end += 2 if toks[end] == "\\" else 1
            if end < n and toks[end] == "/":
                c, k = "r", end + (end + 1 < n and raw[end + 1] == "i")
        if fresh and (c in ("++", "--") or prev in ("return", "break", "continue")) and s[";"] is not g.empty:
            s = s[";"]
        d = s[c]
        if d is g.empty and (fresh or c == "}"):
            d = s[";"][c]
        if d is g.empty:
            return "broken", k
        s, fresh, prev = d, False, c
        k += 1
    if g.nullable(s) or g.nullable(s[";"]):
        return "ok", -1
    return "truncated", n
