"""Labelled exemplars of residue and of ordinary text that resembles it: a passage per line, from public error pages,
template languages and filler, and from reading test documents.  Fixed values."""

#: Messages of error pages.
ERRORS = """
404 not found
page not found
file not found
the requested url was not found on this server
the page you requested could not be found
the page you are looking for doesn't exist or has been moved
this page doesn't exist
this page is no longer available
this page isn't working
sorry we couldn't find that page
we can't seem to find the page you're looking for
we cannot find that sheet
the drawing page you asked for could not be found
this document may have been moved or deleted
nothing lives at this address any more
the link you followed may be broken
no such page
the resource was not found
the requested resource is not available
the requested resource could not be found
could not be located
this content is not available
this content has been removed
this site can't be reached
the server could not be reached
unable to connect
connection refused
connection failed
check your internet connection
the server is not responding
this site can't provide a secure connection
connection reset by peer
connection timed out
took too long to respond
internal server error
something went wrong
oops something went wrong
looks like something went wrong
an error occurred
an error has occurred
an unknown error has occurred
an unexpected error occurred while this page was loading
an error occurred while processing your request
your request could not be processed
the request could not be completed
there was a problem loading this page
could not load this page
trouble loading this page
the page cannot be displayed
the page could not be displayed
could not render page
failed to load resource
our engineers have been told about the problem
our team has been notified
we are working to fix the problem
we apologize for the inconvenience
application error
server error
the server encountered an error
unable to complete your request
unhandled exception
traceback most recent call last
exception in thread main
java lang illegalstateexception connection pool is closed
java lang nullpointerexception
the database is unavailable
could not connect to the database
segmentation fault core dumped
warning undefined index body in srv view page inc on line
fatal error uncaught exception
fatal relation sheet text does not exist at character
fatal relation does not exist at character
you have an error in your sql syntax
error establishing a database connection
query failed
check the address and try again
please check the url
400 bad request
401 unauthorized
403 forbidden
authentication required
authorization required
access denied
access to this resource is denied
you don't have permission to access this resource
you do not have permission to open this folder
you do not have permission to view this page
you are not authorized to view this page
permission required
permission denied
you don't have access to this page
permission to view this page was denied
access to this page has been denied
ask the owner of the library to grant you access
503 service unavailable
the service is temporarily unavailable
the website is temporarily unavailable
the document store is temporarily unable to answer your request
the server is temporarily unable to service your request
the site is down for maintenance
we'll be back soon
down for maintenance
we are performing scheduled maintenance
please come back later
502 bad gateway
504 gateway timeout
gateway time out
received an invalid response from the upstream server
the server returned an invalid or incomplete response
the server received an invalid response
the upstream viewer did not respond in time
request timed out
429 too many requests
too many connections
too many redirects
rate limit exceeded
wait a moment then reload
please try again later
try refreshing the page
reload the page
return to the home page
go back to the homepage
sign in with your work account to read this item
please log in to continue
you must log in to access this page
you need to sign in
sign in to continue
you must be logged in to view this page
you have been signed out
your session has expired
session timed out
please sign in again to continue
your connection is not private
invalid csrf token
페이지 없음
페이지를 찾을 수 없습니다
요청하신 페이지를 찾을 수 없습니다
주소가 바뀌었거나 삭제된 문서입니다
서버 오류
서버 오류가 발생했습니다
일시적인 오류
서버 연결이 지연되고 있습니다
서비스를 일시적으로 이용할 수 없습니다
잠시 후 다시 시도해 주세요
이 문서를 볼 권한이 없습니다
접근 권한이 없습니다
접근 거부
로그인 만료
세션이 만료되었습니다
다시 로그인하십시오
로그인이 필요합니다
seite nicht gefunden
die angeforderte seite wurde nicht gefunden
das angeforderte blatt existiert nicht mehr
bitte prüfen sie die adresse
sitzung abgelaufen
ihre sitzung ist abgelaufen
interner serverfehler
es ist ein fehler aufgetreten
beim laden der seite ist ein fehler aufgetreten
der dienst ist vorübergehend gestört
der server ist derzeit nicht erreichbar
versuchen sie es später erneut
zugriff verweigert
sie haben keine berechtigung für diesen ordner
keine berechtigung
bitte melden sie sich erneut an
"""

#: Notices that scripts are needed.
SCRIPTS = """
please enable javascript
please enable javascript to continue
please enable javascript to view the route sheet
please turn on javascript and reload the page
please enable cookies and reload the page
enable javascript and cookies to continue
you need to enable javascript to run this app
javascript must be enabled to use this site
this application requires javascript to run
this site requires javascript
requires javascript to be enabled
works best with javascript enabled
doesn't work properly without javascript enabled
doesn't work without javascript
cannot be displayed without javascript
cannot be displayed because javascript is disabled
enable javascript to view this content
needs javascript to work
javascript is required
requires javascript
needs javascript
javascript must be enabled
please turn on javascript
javascript is not enabled
javascript is turned off
you have javascript disabled
javascript must be turned on
javascript seems to be disabled
javascript is disabled in your browser
javascript is not available
your browser does not support javascript
your browser has javascript turned off
some parts of this page will not work
some features may not work
scripts and cookies must be allowed
allow scripts
please allow scripts to run
scripts are blocked
script support is required
scripting is turned off
scripting is disabled
scripts are disabled
scripts are turned off
javascript is switched off
your browser has scripts turned off
scripting switched off in your browser
scripting must be enabled
active scripting
checking your browser before opening the viewer
checking your browser before accessing
checking if the site connection is secure
verifying you are human
if nothing appears allow scripts for this site and reload
enable js and disable any ad blocker to continue
disable your ad blocker
for full functionality of this library it is necessary to activate javascript
you need to turn on scripts in your browser to use this viewer
your browser does not support scripting or it is switched off
the viewer cannot be shown
here are the instructions how to enable javascript in your web browser
noscript
스크립트를 허용한 뒤 새로 고침하십시오
브라우저에서 javascript가 꺼져 있습니다
이 페이지를 보려면 자바스크립트를 활성화해 주세요
자바스크립트를 활성화해 주세요
자바스크립트를 사용할 수 없습니다
diese anwendung benötigt javascript
bitte aktivieren sie javascript
bitte aktivieren sie javascript um das blatt anzuzeigen
javascript ist deaktiviert
skripte sind in ihrem browser abgeschaltet
erlauben sie sie und laden sie neu
"""

#: Filler where content should be.
FILLER = """
your text here
your text goes here
text goes here
content goes here
insert text here
insert content here
add your text here
enter your text here
write your text here
click to add text
click here to edit
click to edit this text
click to add title
click to add subtitle
type something about the route in this box
type something here
start typing here
replace this paragraph with your own findings
replace this text with your own
replace with real content
please replace this text
example paragraph
this is sample text and will be replaced by the real section
this is a sample paragraph
this is dummy text
this is placeholder text
this is just a placeholder
this text is a placeholder
placeholder text
placeholder copy
placeholder paragraph
sample text
dummy text
dummy paragraph do not publish
dummy content
filler text
example text
example caption for example figure
the content of this chapter will be written later this passage only shows the layout
content to be added later
to be supplied later
to be written
text to be supplied
to be provided by
description to be added
body copy to follow
copy to follow
text to come
content coming soon
coming soon
section intentionally filled with sample words
blah blah blah
asdf asdf jkl jkl
abc abc abc abc
test test test
foo bar baz
the quick brown fox jumps over the lazy dog
heading goes here
headline goes here
caption goes here
description goes here
your title here
title goes here
add a description here
click here to add a title
add description
write a short summary here
todo write this section
tbd tbd tbd
여기에 본문 내용을 입력하세요
내용을 입력하세요
제목을 입력하십시오
실제 내용으로 바꾸어 주세요
예시 문장입니다
샘플 텍스트 샘플 텍스트
샘플 텍스트입니다
가나다라 마바사 아자차카
hier steht ein beispieltext
hier steht ihr text
hier text einfügen
titel hier eingeben
text folgt
inhalt folgt
blindtext für das layout bitte nicht lesen
dies ist ein blindtext
dieser absatz ist nur ein platzhalter und wird noch ersetzt
"""

#: Filler of words that mean nothing: held against texts by groups of three letters, in any order.
NONSENSE = """
lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua
ut enim ad minim veniam quis nostrud exercitation ullamco laboris nisi ut aliquip ex ea commodo consequat duis aute irure
dolor in reprehenderit in voluptate velit esse cillum dolore eu fugiat nulla pariatur excepteur sint occaecat cupidatat
non proident sunt in culpa qui officia deserunt mollit anim id est laborum
curabitur pretium tincidunt lacus nulla gravida orci a odio nullam varius turpis et commodo pharetra est eros bibendum elit nec luctus
phasellus viverra nulla ut metus varius laoreet quisque rutrum aenean imperdiet etiam ultricies nisi vel augue
donec quam felis ultricies pellentesque eu pretium quis sem massa justo fringilla vel aliquet nec vulputate eget arcu
morbi tempus iaculis urna facilisi duis convallis tellus interdum velit laoreet cras semper auctor neque vitae suspendisse potenti
vivamus vestibulum sagittis sapien cum sociis natoque penatibus et magnis dis parturient montes nascetur ridiculus mus
trukeloden lotru galden qua vexba irostqua mizorpli
loostmi ostzorvexden lovex migal mivex lozor logalkeme tru
vexpliostpli zorvexvex navexnana trunaloba quapli galfu quamequatru mi baqua menaquapli irirlo tru fukevex
tru mefumemi quair zortrume quapliost me mike keke
kefuzorzor nalomezor pli lotrufuba denme zor zorplinafu galfuvex gal ostmidenba baostost vexgal plivexfuvex
qua ost meba den me babavextru quadentru gal keirgal nafumi
dentruirlo fu ost irirdenpli qua baquanaba trumiquaost galirden zordenmeme
pliquafu badenvexmi galbalona ba zorba pli ba kebakeir
fudenba nazordenpli ostzor naquakena vex zor
baplizor quaquaden nazorme ir pli lo nabafuzor denbakezor naostfu mequabalo ostpli
osttrugalvex mimike lo mi lodengalpli pliirir lome irtruvex mimequaba megalvexzor pliloqua
lokeir lofuost trumiost milotru ke
denmiost memeirme zorzor mezorvexba den vex bagalfuden meba zorzornagal ostden nakename nairvexlo denir den
baostzorvex ba mi irquake nagalgalvex den
ketrufume denir miostfuke milo mitrudenden irkeke fulona zor quamilomi bazorlona balomemi plipli denmeden
qua ostzorvexmi quamevex galnavex vexvex miquagal navexfuke zorden
galgal quatruirba irgalirden quairquaqua vexme lofuna fuke namezorpli zorostvex denvexost
irquana vexirkevex balokelo keden lolotrupli quametru fugal gal ba vexlo zordentru kelonapli dendenkeba balona
kemigal quadenloden naquaquagal pliqua keirke menaost lovexloden nadenden mi irvexlo
galfutru vex naost naqua truzorzortru quamitruvex vexnami pligalmequa denbatruzor galdenirzor irlo trubaloost mivexir
bameir ostfu ir trutruost irkelomi galna trutruden keir quazor ir mipliplizor
ostzor ir qua quatruba plilodenba nairlomi
denmezor mevexmi irgalzor irostpligal quavexmimi fu fu na trukenafu fumimike loplizorke ba lo
xx xxx xxxx
"""

#: Unfilled slots; ``name`` stands for any name.
SLOTS = """
{{name}}
{{ name }}
{{{name}}}
{{{ name }}}
{{NAME NAME}}
{name}
{name name}
{NAME NAME}
{0}
{%name%}
{% name %}
${name}
${ name }
${NAME NAME}
$(name)
$(NAME NAME)
$name$
$name name$
$NAME NAME$
<%name%>
<% name %>
<%=name%>
<%= name %>
<<name>>
<< name >>
«name»
« name »
<name>
<name name>
<NAME NAME>
[[name]]
[[ name ]]
[%name%]
[% name %]
[NAME NAME]
[insert name]
[name insert]
[name inserted]
[enter name]
[add name]
[fill in name]
[type name here]
[your name]
[name here]
[describe name]
[choose name]
[select name]
[name to be confirmed]
[name to be completed]
[name goes here]
[TBD]
[TBC]
[placeholder]
[hier name]
[name einsetzen]
[name eintragen]
[name einfügen]
[name ergänzen]
[name 입력]
[name 기입]
[여기에 name]
(fill in name)
(insert name)
(enter name)
(to be added name)
(to be completed name)
(name to be inserted)
(name 입력)
(name eintragen)
%(name)s
%(name)d
%(NAME NAME)s
%NAME%
%s
%d
@@name@@
@@NAME NAME@@
##name##
##NAME NAME##
#name#
#NAME NAME#
__name__
__NAME NAME__
&name;
&name name;
____
○○
□□
"""

#: Ordinary text that is spelled like a slot.
ORDINARY = """
<a> <b> <i> <u> <p> <br> <hr> <li> <ul> <ol> <td> <tr> <th> <dl> <dt> <dd> <em> <h> <div> <span> <table> <thead> <tbody> <body> <html> <head>
<pre> <code> <img> <strong> <small> <sub> <sup> <form> <input> <button> <label> <script> <style> <title> <meta> <link> <nav> <section> <footer>
<ctrl> <shift> <alt> <enter> <esc> <tab> <return> <space> <none> <null> <unknown>
&amp; &lt; &gt; &quot; &apos; &nbsp; &copy; &reg; &deg; &euro; &mdash; &ndash; &hellip; &lsquo; &rsquo; &ldquo; &rdquo; &laquo; &raquo; &times; &middot;
&auml; &ouml; &uuml; &szlig; &eacute; &egrave; &agrave; &ccedil; &ntilde; &plusmn; &micro; &bull; &shy;
__init__ __main__ __file__ __dict__ __all__ __future__
"""

#: Passages that speak about slots; ``slot`` stands for one.
MENTIONS = """
the title block of the exporter uses slot as its slot name it is replaced when the sheet is printed
tags such as slot and slot are identifiers of the checker and stay in the text
in the macro slot is filled from the sheet list so never rename that column
the log format is slot so the third value is always a whole number
the style guide lists the mark slot as the slot for the pipe size on this sheet the size is
do not type slot by hand the macro looks for exactly that mark and puts the bay there
the form calls this field slot and the printer swaps it for the tag of
search all sheets for left over marks like slot before release this week there was none
reviewers rejected the earlier draft because slot was still in two captions both captions are correct now
set the folder with export and call the builder with slot as its only argument
the pattern is written slot in the guide
the template engine replaces slot with the value when the page is rendered
the placeholder slot in the template is filled by the exporter
the variable slot is replaced by the value at run time
the syntax slot stands for a variable
the parameter slot is passed to the script
write slot to escape the braces
보고서 양식의 slot 칸은 출력할 때 채워지므로 이름을 바꾸지 말 것
양식 설명서에 따르면 slot 표시는 출력 프로그램이 장비 이름으로 바꾸는 칸이다
im formular heißt das feld slot es wird beim druck ersetzt
laut anleitung ist slot das feld für die nennweite auf diesem blatt gilt
"""
