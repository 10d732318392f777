"""The grammars of the supported languages, in the notation of ``peg``; only syntax counts, not names or types."""

JSON = r"""
text <- value END
value <- {STR NUM true false null} / '{' (member (',' member)*)? '}' / '[' (value (',' value)*)? ']'
member <- STR ':' value
"""

SOLIDITY = r"""
unit <- part* END
part <- pragma / import_one / using / contract / function / struct / enum / event / error_one / value_type / file_constant
pragma <- 'pragma' (!{; <end>} any)+ ';'
import_one <- 'import' (STR ('as' id)? / '*' 'as' id from_word STR / '{' symbol (',' symbol)* '}' from_word STR) ';'
symbol <- id ('as' id)?
from_word <- 'from'
contract <- 'abstract'? {contract interface library} id ('is' base (',' base)*)? ('layout' 'at' expr)? '{' member* '}'
base <- path arguments?
member <- using / constructor / function / modifier / struct / enum / event / error_one / value_type / variable
using <- 'using' (path / '{' path ('as' operator)? (',' path ('as' operator)?)* '}') 'for' ('*' / type) 'global'? ';'
operator <- {& | ^ ~ + - * / % == != < > <= >=}
constructor <- 'constructor' parameters attribute* block
function <- 'function' id? parameters attribute* ('returns' parameters)? (block / ';') / &special id parameters attribute* ('returns' parameters)? (block / ';')
special <- {fallback receive}
attribute <- {public private internal external pure view payable constant virtual immutable} / 'override' ('(' path (',' path)* ')')? / &{ID error from global leave revert} path arguments?
modifier <- 'modifier' id parameters? {virtual}? ('override' ('(' path (',' path)* ')')?)? {virtual}? (block / ';')
parameters <- '(' (parameter (',' parameter)*)? ')'
parameter <- type {memory storage calldata}? 'indexed'? id?
struct <- 'struct' id '{' (type id ';')* '}'
enum <- 'enum' id '{' (id (',' id)*)? '}'
event <- 'event' id parameters 'anonymous'? ';'
error_one <- 'error' id parameters ';'
value_type <- 'type' id 'is' elementary ';'
variable <- type variable_word* id ('=' expr)? ';'
file_constant <- type 'constant' id '=' expr ';'
variable_word <- {public private internal external constant immutable transient} / 'override' ('(' path (',' path)* ')')?
elementary <- {ELEMENTARY address bool string bytes byte fixed ufixed var}
id <- {ID error from global revert leave case switch default receive fallback layout at transient}
any <- !END {ID NUM STR HEX USTR OP ELEMENTARY ^ ~ >= <= > < = . - || * / + , : ( ) [ ] & ! % == error from abstract experimental solidity}
path <- id ('.' (id / 'address'))*
type@ <- basic ('[' expr? ']')*
basic <- 'address' 'payable'? / elementary / mapping / function_type / path
mapping <- 'mapping' '(' (elementary / path) id? '=>' type id? ')'
function_type <- 'function' parameters {public private internal external pure view payable constant}* ('returns' parameters)?
block <- '{' statement* '}'
statement <- block / 'unchecked' block / if_one / for_one / while_one / do_one / {continue break throw _} ';' / return_one / try_one / emit_one / revert_one / assembly / declared ';' / expr ';'
if_one <- 'if' '(' expr ')' statement ('else' statement)?
for_one <- 'for' '(' (';' / declared ';' / expr ';') expr? ';' expr? ')' statement
while_one <- 'while' '(' expr ')' statement
do_one <- 'do' statement 'while' '(' expr ')' ';'
return_one <- 'return' expr? ';'
try_one <- 'try' expr ('returns' parameters)? block catch_one+
catch_one <- 'catch' (id? parameters)? block
emit_one <- 'emit' path arguments ';'
revert_one <- 'revert' path arguments ';'
declared <- type {memory storage calldata}? id ('=' expr)? / 'var' '(' id? (',' id?)* ')' '=' expr / '(' slot (',' slot)* ')' '=' expr
slot <- (type {memory storage calldata}? id)?
expr@ <- unary (binary unary)* ('?' expr ':' expr)?
binary <- {+ - * / % ** << >> >>> & | ^ && || == != < > <= >= = += -= *= /= %= |= &= ^= <<= >>= >>>=}
unary <- {! ~ - ++ -- delete +} unary / postfix
postfix <- primary tail*
tail <- '.' (id / 'address' / 'length' ) / '[' expr? (':' expr?)? ']' / '{' (named (',' named)*)? '}' &'(' / arguments / {++ --}
named <- id ':' expr
arguments <- '(' ('{' (named (',' named)* ','?)? '}' / expr (',' expr)*)? ')'
primary <- NUM unit_word? / STR+ / HEX+ / USTR+ / {true false this super} / 'new' type / 'type' '(' type ')' / 'payable' / tuple / '[' expr (',' expr)* ']' / elementary / 'mapping' / id
unit_word <- {wei gwei ether szabo finney seconds minutes hours days weeks years}
tuple <- '(' expr? (',' expr?)* ')'
assembly <- 'assembly' STR? ('(' STR (',' STR)* ')')? yul_block
yul_block <- '{' yul* '}'
yul <- yul_block / 'let' yid (',' yid)* (':=' yexpr)? / 'if' yexpr yul_block / 'for' yul_block yexpr yul_block yul_block / 'switch' yexpr yul_switch / {leave break continue} / 'function' yid '(' (yid (',' yid)*)? ')' ('->' yid (',' yid)*)? yul_block / ypath (',' ypath)* ':=' yexpr / yexpr
yul_switch <- ('case' yliteral yul_block)+ ('default' yul_block)? / 'default' yul_block
yid <- {ID error from global revert receive fallback address byte return type at layout}
ypath <- yid ('.' yid)*
yexpr <- ypath '(' (yexpr (',' yexpr)*)? ')' / yliteral / ypath
yliteral <- {NUM STR HEX true false}
"""

JAVASCRIPT = r"""
program <- item* END
item <- import_one / export_one / statement
import_one <- 'import' !{( .} (STR / import_names 'from' STR) (('with' / ID) object)? semi
import_names <- word (',' (star / braces))? / star / braces
star <- '*' 'as' word
braces <- '{' (spec (',' spec)*)? ','? '}'
spec <- name ('as' (name / STR))? / STR 'as' name
export_one <- 'export' ('*' ('as' (name / STR))? 'from' STR semi / braces ('from' STR)? semi / 'default' (function / class / async_function / assign semi) / variable semi / named_function / named_async / named_class)
semi <- ';' / &{RB <end>} / #nl
word <- {ID async of get set static from as let await yield}
name <- {ID async of get set static from as let await yield break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with}
statement <- block / ';' / variable semi / named_function / named_async / named_class / if_one / for_one / while_one / do_one / jump / with_one / switch_one / throw_one / try_one / 'debugger' semi / label / !{function class {} !('let' '[') !('async' !#nl 'function') expr semi
label <- word ':' statement
block <- '{' statement_in* '}'
statement_in <- statement
variable <- {var const} bind (',' bind)* / 'let' bind (',' bind)*
bind <- (word / pattern) ('=' assign)?
for_bind <- {var const let} (word / pattern)
pattern@ <- '{' (prop_pattern (',' prop_pattern)*)? ','? '}' / '[' (element_pattern / ',')* ']'
prop_pattern <- '...' (word / pattern) / key ':' target / word ('=' assign)?
target <- (word / pattern) ('=' assign)?
element_pattern <- '...' (word / pattern) / target
if_one <- 'if' '(' expr ')' statement ('else' statement)?
for_one <- 'for' 'await'? '(' (for_bind {of in} expr / for_bind 'in' expr / variable ';' expr? ';' expr? / ';' expr? ';' expr? / left {of in} expr / expr ';' expr? ';' expr?) ')' statement
while_one <- 'while' '(' expr ')' statement
do_one <- 'do' statement 'while' '(' expr ')' ';'?
jump <- 'return' (!#nl expr)? semi / {break continue} (!#nl word)? semi
with_one <- 'with' '(' expr ')' statement
switch_one <- 'switch' '(' expr ')' '{' (('case' expr / 'default') ':' statement_in*)* '}'
throw_one <- 'throw' !#nl expr semi
try_one <- 'try' block ('catch' ('(' (word / pattern) ')')? block ('finally' block)? / 'finally' block)
function <- 'function' '*'? word? parameters block
named_function <- 'function' '*'? word parameters block
named_async <- 'async' !#nl 'function' '*'? word parameters block
async_function <- 'async' !#nl 'function' '*'? word? parameters block
parameters <- '(' (element_pattern (',' element_pattern)*)? ','? ')'
named_class <- decorator* 'class' word ('extends' left)? '{' class_item* '}'
class <- decorator* 'class' (!'extends' word)? ('extends' left)? '{' class_item* '}'
decorator <- '@' left
class_item <- ';' / decorator* ('static' block / modifiers (key / PRIVATE) (parameters block / ('=' assign)? semi))
modifiers <- ('static' !{( = ; RB})? ({get set} !{( = ; RB} / ('async' !{( = ; RB} !#nl)? '*'?)
key <- name / STR / NUM / '[' assign ']'
expr <- assign (',' assign)*
assign@ <- arrow / 'yield' (!#nl ('*'? assign))? / target_left assign_op assign / conditional
assign_op <- {= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=}
target_left@ <- word !more / '(' target_left ')' !more / start (tail &more)* ('.' (name / PRIVATE) / '[' expr ']') !more / pattern
more <- {. ?. [ ( TEMPLATE HEAD}
arrow <- ('async' !#nl)? (word / parameters) !#nl '=>' (block / assign)
conditional <- unary (binary unary)* ('?' assign ':' assign)?
binary <- {+ - * / % ** << >> >>> & | ^ && || ?? == != === !== < > <= >= instanceof in}
unary <- {! ~ + - typeof void delete} unary / 'await' unary / {++ --} left / left (!#nl {++ --})? / PRIVATE &'in'
left@ <- start tail*
start@ <- 'new' ('.' word / new_target ('(' arguments ')')?) / 'import' ('.' word / &'(') / primary
new_target <- 'new' new_target ('(' arguments ')')? / primary ('.' (name / PRIVATE) / '[' expr ']' / template)*
tail <- '.' (name / PRIVATE) / '?.' ('(' arguments ')' / '[' expr ']' / name / PRIVATE / template) / '[' expr ']' / '(' arguments ')' / template
arguments <- (argument (',' argument)*)? ','?
argument <- '...'? assign
template <- TEMPLATE / HEAD expr (MIDDLE expr)* TAIL
primary <- {NUM STR REGEX true false null this super} / template / async_function / function / class / array / object / '(' expr ')' / word
array <- '[' (argument / ',')* ']'
object <- '{' (property (',' property)*)? ','? '}'
property <- '...' assign / property_modifiers key parameters block / key ':' assign / word ('=' assign)?
property_modifiers <- {get set} !{( : , RB =} / ('async' !{( : , RB =} !#nl)? '*'?
"""
PYTHON = r"""
file <- statement* END
statement <- compound / simple_line
simple_line <- simple (';' simple)* ';'? NEWLINE
simple <- assignment / 'return' star_list? / import_one / raise_one / 'pass' / del_one / yield_one / 'assert' test (',' test)? / {break continue} / {global nonlocal} word (',' word)* / type_alias / star_list
type_alias <- 'type' word type_params? '=' test
assignment <- word ':' test ('=' right)? / single ':' test ('=' right)? / (targets '=')+ right !'=' / single augmented (yield_one / star_list)
augmented <- {+= -= *= @= /= %= &= |= ^= <<= >>= **= //=}
right <- yield_one / star_list
single <- primary_target / '(' single ')'
primary_target <- atom_target / word
atom_target <- primary_head &{. [ (} target_tail
targets@ <- star_target (',' star_target)* ','?
star_target <- '*' star_target / target
target <- atom_target / word / '(' targets? ')' / '[' targets? ']'
primary_head <- atom
target_tail <- (call_tail &{. [ (} )* ('.' word / '[' slices ']') !{. [ (}
call_tail <- '.' word / '[' slices ']' / '(' arguments ')'
import_one <- 'import' dotted_as (',' dotted_as)* / 'from' ({. ...}* dotted / {. ...}+) 'import' ('*' / '(' from_as (',' from_as)* ','? ')' / from_as (',' from_as)*)
dotted_as <- dotted ('as' word)?
from_as <- word ('as' word)?
dotted <- word ('.' word)*
raise_one <- 'raise' (test ('from' test)?)?
del_one <- 'del' targets
yield_one <- 'yield' ('from' test / star_list)?
compound <- if_one / while_one / for_one / try_one / with_one / function / class / decorated / match_one / 'async' (function / for_one / with_one)
block <- NEWLINE INDENT statement+ DEDENT / simple_line
if_one <- 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)?
while_one <- 'while' named ':' block ('else' ':' block)?
for_one <- 'for' targets 'in' star_list ':' block ('else' ':' block)?
try_one <- 'try' ':' block (except_one+ ('else' ':' block)? ('finally' ':' block)? / 'finally' ':' block)
except_one <- 'except' '*'? (test (',' test)* ('as' word)?)? ':' block
with_one <- 'with' ('(' with_item (',' with_item)* ','? ')' ':' / with_item (',' with_item)* ':') block
with_item <- test 'as' star_target &{, ) :} / test
function <- 'def' word type_params? '(' parameters? ')' ('->' test)? ':' block
type_params <- '[' type_param (',' type_param)* ','? ']'
type_param <- ('*' / '**')? word (':' test)? ('=' test)?
class <- 'class' word type_params? ('(' arguments ')')? ':' block
decorated <- ('@' named NEWLINE)+ ('async'? function / class)
parameters <- parameter_plain (',' parameter_plain)* (',' '/' (',' parameter_plain)*)? (',' parameter_rest)? ','? / parameter_rest ','?
parameter_plain <- word (':' test)? ('=' test)?
parameter_rest <- '*' word (':' ('*'? test))? (',' parameter_plain)* (',' parameter_keywords)? / '*' (',' parameter_plain)+ (',' parameter_keywords)? / parameter_keywords
parameter_keywords <- '**' word (':' test)?
match_one <- 'match' star_named ':' NEWLINE INDENT case_one+ DEDENT
star_named <- star_item (',' star_item)* ','?
case_one <- 'case' case_patterns ('if' named)? ':' block
case_patterns <- case_star (',' case_star)* ','?
case_star <- '*' word / case_as
case_as <- case_or ('as' word)?
case_or <- case_atom ('|' case_atom)*
case_atom <- '-'? NUM ({+ -} NUM)? / STR+ / {None True False} / '(' case_patterns? ')' / '[' case_patterns? ']' / '{' (case_item (',' case_item)* ','?)? '}' / word ('.' word)* ('(' (case_argument (',' case_argument)* ','?)? ')')?
case_item <- '**' word / (STR+ / '-'? NUM ({+ -} NUM)? / {None True False} / word ('.' word)*) ':' case_as
case_argument <- word '=' case_as / case_as
star_list <- star_item (',' star_item)* ','?
star_item <- '*' or_expr / named
named <- word ':=' test / test !':='
test@ <- lambda / or_test ('if' or_test 'else' test)?
lambda <- 'lambda' lambda_parameters? ':' test
lambda_parameters <- lambda_parameter (',' lambda_parameter)* ','?
lambda_parameter <- '/' / '**' word / '*' word? / word ('=' test)?
or_test <- not_test ({and or} not_test)*
not_test <- 'not' not_test / comparison
comparison <- or_expr (compare or_expr)*
compare <- {== != < > <= >= in} / 'not' 'in' / 'is' 'not'?
or_expr <- factor ({| ^ & << >> + - * / // % @ **} factor)*
factor <- {+ - ~} factor / 'await' primary / primary
primary@ <- atom call_tail*
atom <- word / {NUM None True False ...} / STR+ / '(' (yield_one / comprehended / star_list)? ')' / '[' (comprehended / star_list)? ']' / '{' (dict_items / comprehended / star_list)? '}'
comprehended <- (named / '*' or_expr) comp_for+
comp_for <- 'async'? 'for' targets 'in' or_test ('if' comp_if)*
comp_if <- word ':=' or_test / or_test
dict_items <- test ':' test comp_for+ / dict_item (',' dict_item)* ','?
dict_item <- '**' or_expr / test ':' test
slices <- slice (',' slice)* ','?
slice <- '*' or_expr / test? ':' test? (':' test?)? / named
arguments <- (argument (',' argument)* ','?)?
argument <- '*' test / '**' test / word '=' test / (word ':=' test / test !{= :=}) comp_for*
word <- {ID match case type _}
"""
