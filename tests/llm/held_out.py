"""Phrases written after the exemplars of residue were fixed, a passage per line.

Only the share of a sentence was set in view of them (from 0.5 to 0.42).
"""

ERRORS = """
The page you have requested is no longer available.
We're sorry, but an error has occurred on the server.
Error 403: you don't have permission to view this folder.
HTTP 500: an internal server error was reported to us
The connection to the server was reset while the page was loading.
Please log in again, your session is no longer valid.
The viewer did not respond in time, please try again.
This document could not be found. It may have been deleted.
An internal error occurred. Please try again later.
The database is temporarily unavailable, please try again.
Unable to load this page.
You need to log in before you can view this document.
Sorry! We can't find the page you requested.
The file you requested does not exist.
Application error: a client-side exception has occurred
Traceback (most recent call last): File "main.py", line 3
The server is currently unavailable.
Zugriff auf diese Seite verweigert.
페이지를 표시할 수 없습니다. 잠시 후 다시 시도해 주세요.
"""

SCRIPTS = """
Please enable JavaScript to use this viewer.
This drawing viewer needs JavaScript enabled.
JavaScript is not enabled in this browser.
You must enable JavaScript to open the model.
Some features will not work because JavaScript is disabled.
Your browser has JavaScript disabled, please turn it on.
For the best experience, please enable scripts.
This app works best with JavaScript enabled.
Please activate JavaScript and reload.
Checking your browser, please wait.
Diese Seite benötigt JavaScript.
"""

FILLER = """
Your heading here
This is placeholder content.
Click to add notes
Sample text, to be replaced later.
Text goes here and here.
Dolor sit amet, sed do eiusmod tempor et dolore magna.
Add your content here
Insert a description here.
Dummy text dummy text dummy text
Content to follow.
Enter text here
Type here to add a caption
xx xxxx xxx xx
blah blah blah blah
Beispieltext, bitte ersetzen. Dies ist ein Blindtext.
이 문단은 샘플 텍스트입니다.
"""

SLOTS = """
The header at {{level}} was moved.
The bay is %(bay_id)s today.
The owner is [insert owner name].
The list was sent to <recipient address> on Friday.
Length ${pipe.length} in total.
The support [SUPPORT NUMBER] is loose.
Route <%= route_id %> ends here.
Signed __________ on Monday.
Dear [your name], the drawing is ready.
The tag is ##TagNumber## on both sheets.
Flow [[flow_rate]] at the outlet.
Approved on {approval date} by the owner.
The unit is $UNIT$ as agreed.
The value of @@pressure@@ was entered.
The tank «TankId» was cleaned.
Contact (insert contact) for the keys.
The level is {% level %} mm.
Use <<valve tag>> for the drain.
"""

HARMLESS = """
The page numbers of both sheets agree.
The request was sent to the owner and was approved.
The line could not be connected before the outage.
The server of the control system stands in room 4.
Error bars show one standard deviation.
The failure of the gasket was found on Monday.
A service lift is available at the gate.
The exception was approved by the safety team.
The timeout relay opens after 30 s.
The user of the tool asked for access from the north.
Please send the missing sheets again.
Please check the address of the supplier on the label.
The valve is not available before March.
The link between both trunks was removed.
The bad weld at the gateway was ground off.
The plan was loaded on the truck at nine.
The browser cache of the viewer takes 2 GB on the shared disk.
JavaScript and Python are used for the two converters.
The script moves the labels by 3 mm.
Features that need power are listed in section 5.
The sample line is connected to the analyser.
The text in the box gives the nominal size.
Add 5 mm to each side of the sleeve.
The title of sheet 4 was changed.
Type B supports are used here.
Click noises were heard at the valve.
The caption under figure 3 names the bay.
The dummy load was connected for the test.
Content below the second line is in German.
The template was applied at the end of the route.
The note {R-H-D} in the list is the pattern code of 3 letters.
Take bolts (M12) and nuts (M12) from the box.
The set [1, 2, 3] lists the levels.
The vector <0.5, 0.2, 0.1> points up.
The size is 50 % of the header & 20 % of the trunk.
Use item #4 or item #5.
The path is C:\\temp\\list_of_lines.txt on both machines.
The list for 2024 costs $40 and the one for 2025 costs $60.
Ask QA-2 @ bay 5 or QA-3 @ bay 6.
The result of max(a, b) is the level.
Der Zugang zur Bühne ist frei.
Die Leitung wurde geprüft und freigegeben.
Der Text auf dem Schild ist lesbar.
경로가 기둥과 간섭하지 않는다.
배관 내용물은 물이다.
"""
