"""The labelled table from which the recognizer of personal information is trained.

It is small and made by rule: sentences with slots in four languages, written for this purpose about households, offices,
schools, clubs, workshops and journeys, phrases that are put together from lists, and rules that fill the slots. A row is
a text of a few sentences with the spans of its personal information. No sentence is taken from a corpus; all names,
numbers and addresses are invented.
"""

from __future__ import annotations

import random
from collections.abc import Callable

KINDS = ("email", "phone", "id_number", "address", "name")

# Words that say what stands beside them, by class. A word may be in several classes.
CUES = {
    "title": "mr mrs ms miss dr prof professor sir madam herr frau fräulein señor señora señorita sr sra don doña monsieur madame mademoiselle mme mlle m rev captain",
    "role": "manager server waiter waitress hostess host cook chef owner barista cashier clerk bartender technician receptionist stylist mechanic guide teacher nurse plumber driver doctor neighbour neighbor colleague coach tutor lawyer agent secretary landlord landlady tenant editor painter gardener carpenter electrician pilot librarian caretaker porter usher baker butcher barber dentist vet trainer boss assistant supervisor director treasurer chairman conductor nanny sitter roommate cousin uncle aunt sister brother niece nephew friend kellner kellnerin chef besitzer nachbar nachbarin lehrerin lehrer arzt kollege kollegin camarero camarera dueño dueña vecino vecina profesor profesora médico jefe jefa serveur serveuse patron patronne voisin voisine professeur médecin collègue",
    "close": "regards sincerely yours truly cheers love best thanks signed saludos atentamente abrazos grüße gruß grüßen herzlich cordialement amicalement bises faithfully warmly",
    "greet": "dear hello hi hey hola querido querida liebe lieber hallo cher chère bonjour",
    "label": "name contact customer guest patient client attendee sender recipient attn from to nombre nom kunde cliente teilnehmer absender by",
    "place": "in near at around outside toward towards via beyond nach bei aus en cerca desde hasta à vers chez entre",
    "town": "springs falls bay hills city town port flats ridge valley beach lake river wells mills harbour harbor island county village heights cove glen haven ford marsh creek grove point",
    "firm": "grill bistro hotel cafe café kitchen house tavern diner bar bakery garage salon inn pub restaurant market shop store ltd inc gmbh sons brothers company clinic studio deli pizzeria lounge bank school museum theatre gallery hostel spa gym pharmacy laundry festival fair club",
    "street": "st street rd road ave avenue ln lane dr drive blvd boulevard way ct court pl place ter terrace sq square cir circle pkwy parkway hwy highway row walk close crescent trail loop alley path quay wharf mews rue chemin quai allée impasse cours route calle avenida plaza paseo camino ronda cuesta travesía straße strasse weg gasse allee platz damm ufer",
    "phone": "phone tel telephone call calls text texts mobile cell fax ring rang dial whatsapp handy telefon telefonnummer anrufen rufen ruf anruf appelez appeler téléphone portable llame llama llámame llamar móvil teléfono reach sms voicemail hotline ext",
    "id": "ssn social security passport passeport pasaporte reisepass ausweis personalausweis licence license führerschein permis carnet dni nie nif tax taxpayer steuernummer steuer national identity identité identidad id itin nino insee citizen visa immigration",
    "code": "order booking invoice ticket loyalty member membership sku room reservation ref reference confirmation tracking receipt serial model bestellung rechnung factura pedido reserva commande facture réservation article item isbn flight voucher coupon case parcel policy batch points part gate lot version stock",
    "live": "live lives lived living address home ship deliver deliver delivered sent mail flat house moved wohne wohnt adresse anschrift vivo vive dirección domicilio habite domicile reside pick letters parcel",
}

# Sentences with personal information; <k> opens a slot of kind k, a slash before a slot a new line.
CARRIERS = """
Drop a line to <email> once the fence is painted.|The choir collects songs under <email>|<email> is where the minutes go|Forward the scan to <email>, would you?|New e-mail since June: <email>|Questions about rent (<email>) are welcome.|cc <email> on everything|from: <email>|To unsubscribe use <email>.|Send your essay via <email>!|The tutor's inbox, <email>, bounced twice.|Puedes mandar las fotos a <email>.|Mi buzón nuevo: <email>|Das Formular geht an <email>.|Unter <email> melden.|Envoyez le dossier sur <email>.|Mon courriel est <email>|[<email>]|reply-to <email>|<Made> a <email>.|<Made> an <email>|<Made> à <email>
Ring <phone> when the boiler leaks.|Grandma's landline is <phone>.|Dial <phone> for the school office|The plumber left <phone> on the fridge.|phone <phone>|tel. <phone>, mornings|Cell: <phone>|fax no <phone>|Her new mobile is <phone>|Emergency contact <phone>, any hour|Voicemail went to <phone> again|leave a text under <phone>|Number for the caretaker: <phone>|<phone> is engaged all day.|Mi móvil nuevo es el <phone>|Llama mañana al <phone>.|Das Büro hat die <phone>.|Meine Handynummer lautet <phone>|Vous pouvez joindre l'école au <phone>.|Son portable : <phone>|SMS to <phone> please, ext. 7|(<phone>)|<phone>, extension 31|reach: <phone>|Ring me at <phone>|rang me from <phone>|my cell is <phone> if needed|<name>, (<phone>), has it|call her under <phone> ext. 3|Llámanos al <phone>|Appelle le <phone>|Ruf die <phone> an|The line <phone> is dead.|text the shop: <phone>|who: <name> / phone: <phone>|Hotline <phone> / weekdays|<Made> al <phone>.|<Made> le <phone>
The clerk copied SSN <ssn> onto a napkin.|social security no. <ssn> printed on a payslip|My social is <ssn> and it got leaked|passport <passport> expires in May|The visa desk noted passport number <passport>.|travel document: passport <passport>|Tax number <tax> was typed wrong.|tax identification <tax>|her taxpayer id <tax>|Licence number <licence>, renewed in autumn|my driving license is <licence>|driver license: <licence>|identity card <national>|National identity number <national>|His ID is <national>.|Under citizen id he wrote <national>.|The box for tax id held <tax>.|The guard read passport <passport> over the radio.|On page two stands <ssn>, my social security entry.|They printed <passport> beside the word passport.|<licence> is what my licence says.|The field national id shows <national>|<ssn> (social security)|Her visa form has <passport> under passport.|The landlord asked for my SSN, so I wrote <ssn>.|She dictated her tax number: <tax>.|Mi pasaporte es el <passport>.|DNI <national>|NIE: <national>, caducado|Mein Reisepass hat die Nummer <passport>.|Steuernummer: <tax>|Ausweis <national> verloren|Le passeport <passport> est périmé.|carte d'identité <national>|permis de conduire <licence>|número de identidad <national>|numéro de sécu <ssn>|Sozialversicherung <ssn>|seguridad social <ssn>|social sec. <ssn>|the state wants my SSN: <ssn>|his national id card <national>|(ID <national>)|Her passport (<passport>) was found.|Führerschein <licence>|ID no. <national>|Where it asks for the licence I put <licence>.|He put <ssn> in the field for social security.|I wrote <passport>, as my passport says.|They demanded SSN <ssn> for a key.|Why print driver license <licence> on it?|On the slip: passport no. <passport>!|tax id no. <tax>|immigration file, passport <passport>, closed
Our new flat: <address>|We moved to <address> in spring.|The piano goes to <address>, second bell.|Grandpa still lives at <address> with two cats.|Parcel for <address>|deliver to <address> after five|Return to sender: <address>|Take the van to <address>, then ring.|The garage sale is at <address> this Saturday.|address <address>|house keys for <address> are with me|My parents' home, <address>, was sold.|<address>, ground floor|from <address> it is ten minutes on foot|Billing address: <address>, Norwick|bring the ladder over to <address> please|Vivimos en <address> desde enero.|Mi domicilio es <address>|Wir wohnen jetzt <address>, dritter Stock.|Anschrift: <address>|Die Post ging an <address>.|J'ai déménagé au <address>.|Le colis arrive au <address> demain.|adresse <address>|letters reach her at <address>|The choir practises in a barn behind <address>.|<address>|Nobody opened at <address>.|at home: <address>|where: <address>|who, where: <name>, <address>|contact address <address>|please post it to <address>, <place>|<address>, <place>|our address: <address>, <place>.|Wohnort: <address>|reach me here: <address>|<address> (second floor)|Her aunt at <address> bakes.|send the chairs to <address>, <place>|<name>/<address> <place>|Wir sind <address> zu finden.|Estamos en <address>.|Nous sommes au <address>.
<name>/<address>|<name>/<phone>|<name>/<email>|Cheers,/<name>/<phone>|Love,/<name>|Sincerely,/<name>/<address>|<name> - <phone>|<name> - <email>|coach: <name> - <email>|captain: <name> - <phone>|<name>: <phone>|<name>, <address>|<name> <<email>>|tenant: <name>, flat at <address>|pupil <name>, mother's cell <phone>|sender <name>, <address>|Plumber <name>: <phone>|babysitter <name> (<phone>)|<name> lives at <address>.|<name> can be reached under <phone>.|<name> reads mail at <email>.|Passport of <name>: <passport>|<name>, SSN <ssn>|The form of <name> says <national> for identity card.|ask <name> or write <email>|Keys: <name>, <address>, <phone>|Atentamente,/<name>/<email>|Mit besten Grüßen/<name>/<phone>|Amicalement,/<name>/<address>|<name> (<email>) keeps the list.|<name> (<phone>) has the ladder.|<name> (<address>) won the raffle.|Talk to <name>, <phone>, about the shed.|Talk to <name>, <email>, about the shed.|guest <name> - cell <phone>|tenant <name> - mail <email>|member <name> - lives <address>
"""

# Sentences around one name.
NAMES = """
<name> borrowed the drill.|<name> fixed my bike in an hour.|I think <name> sings better.|Did <name> feed the cat?|We voted for <name>.|<name> and <name> won the relay.|<name>, could you bring chairs?|It was <name> who found the keys.|According to <name> the train is late.|<name>'s umbrella is still in the hall.|The kids adore <name>.|nobody told <name>|Happy birthday <name>!|<name> here, calling about the lamp.|This is <name> speaking.|I am <name> from the third floor.|My name's <name>.|they call me <name>|hand the parcel to <name>|The letter was addressed to <name>.|a nurse called <name> took the sample|someone named <name> phoned|<name> wrote the minutes|lunch with <name> and the twins|seat 14: <name>|Absent: <name>, <name>|Written by <name>|photo: <name>|Attn <name>|c/o <name>|reserved for <name>|filed under <name>|I told <name> everything.|Give this to <name> after class.|<name> was kind to us, and so was <name>.|Yesterday <name> repaired the heating.|Big thanks, <name>!|many thanks to <name>|Kudos to <name> from accounting.|Hats off to <name> behind the counter.|Praise goes to <name> and the crew.|praise for <name>|bravo <name>|Look for <name>, who keeps the register.|Speak to <name>, who manages the hall.|talk with <name> if it breaks|We ran into <name> near the exit.|I saw <name> on the stairs.|Meeting with <name> moved to four.
Sincerely, <name>|Yours truly, <name>|Cheers, <name>|Love, <name>|Kind greetings, <name>|- <name>|-- <name>|xoxo <name>|Thanks,/<name>|Cheers/<name>|Warmly,/<name>|written and signed: <name>|Un abrazo, <name>|Atentamente, <name>|Herzlich, <name>|Liebe Grüße, <name>|Bien à toi, <name>|Amicalement, <name>|Hi <name>,|Dear <name>,|Hello <name>, quick question.|Hola <name>, ¿vienes?|Liebe <name>, bis morgen.|Hallo <name>!|Cher <name>, merci encore.|Bonjour <name>,
<name> hat den Schlüssel.|Ich habe <name> getroffen.|Mein Name ist <name>.|ich bin <name> aus dem Chor|Fragen Sie <name> an der Kasse.|Dank <name> läuft die Heizung.|Danke, <name>.|<name> kommt später.|gestern rief <name> an|Das Paket ist für <name>.|<name> tiene las llaves.|Mi nombre es <name>.|soy <name>, del segundo|Conocí a <name> en la estación.|Gracias, <name>.|Gracias a <name> funciona la luz.|<name> llega tarde.|el paquete es para <name>|Pregunta por <name> en recepción.|<name> a les clés.|Mon nom est <name>.|je suis <name>, du club|J'ai croisé <name> au marché.|Merci <name> !|Merci à <name> pour son aide.|<name> arrive demain.|demandez <name> à la caisse|le colis est pour <name>|mi hermana <name> estudia|mein Bruder <name> zieht um|ma cousine <name> déménage
Name: <name>|Patient: <name>|client: <name>|Nombre: <name>|Nom : <name>|Kunde: <name>|attendee: <name>, paid|Sender: <name>|host: <name>|driver: <name>|teacher: <name>|Contact person: <name>|<b>Name</b>: <name>|Owner: <name>|From: <name>|To: <name>
"""

# What a title or a role with a name may do, and what may stand before a role.
DEEDS = "fixed the lift|sat next to me|sent the forms back|smiled a lot|did not answer|came by at noon|is on leave|lost the ticket|showed us around|explained the rules|was a star|helped a lot|deserves a raise|called in sick|called back|laughed about it|has the spare keys|retired in May|was rude|raised a complaint|told us to wait|made our day|saved the evening|is the best|took the photos|teaches on Fridays|kam zu spät|hat alles erklärt|war sehr nett|half uns sofort|nos ayudó mucho|fue muy amable|llegó tarde|est très gentil|nous a aidés|était absente|apologised at once|served us|knows every street|remembered us".split("|")
OPENERS = "Then|Ask|When|While|Because|And|But|So|Now|Later|Today|Yesterday|Once|Maybe|If|Since|Does|Did|Was|Only|Even|Again|Luckily|After that|Tell|Bring|Give|Follow|Trust|Invite|Find|Help|Why|How|Who|That|Here|There|With|Without|For|Dann|Gestern|Heute|Wenn|Weil|Und|Aber|Fragt|Luego|Ayer|Hoy|Cuando|Pero|Puis|Hier|Quand|Mais|Alors".split("|")
BEFORE_ROLE = "our|my|the|their|your|his|her|an|a|that|unser|unsere|mein|meine|der|die|nuestro|nuestra|mi|el|la|notre|mon|ma|le".split("|")

# Sentences without personal information. Slots as in Filler.slot.
OTHERS = """
The <thing> in the hallway needs a new bulb.|Please water the <thing> twice a week.|I swapped the <thing> for a <thing>.|The <made> pump sounds like a kettle.|A <made> is what the manual calls this lever.|Pass me the <made> and the <thing>.|The <thing> was <adj>, the <thing> less so.|Class starts in <num> minutes.|<num> chairs are missing from the hall.|We counted <num> ducks on the pond.|The ferry leaves at <time>.|Doors open <time>, curtain at <time>.|Tickets cost <price> each.|The roof repair came to <price>.|She paid <price> and got a <thing>.|Back on <date>, weather permitting.|Deadline: <date>.|The <adj> <thing> stays with us.|Nothing beats a <adj> <thing> after rain.|My aunt calls it a <made>, I call it a <thing>.
We hiked from <place> to <place>.|The road to <place> is closed.|There is snow in <place>.|A cousin owns a barn near <place>.|The <place> train was late.|<place> has <num> bridges.|Greetings from <place>!|Is <place> worth a detour?|Choirs from <place> and <place> sang.|The map shows <place> north of <place>.|Buses for <place> stop here.|People of <place> vote tomorrow.|born in <place>, raised in <place>|Storm over <place>.|Welcome to <place>.|The lighthouse of <place> was painted.|The concert in <place> was moved.|Le concert à <place> est annulé.|La fête de <place> commence.|Das Konzert in <place> fällt aus.|Welcome to <place>.|We are near <firm>.|Greetings, everyone.|The <firm> band played.|The <firm> team practises.|beside <firm>, upstairs|next door to <firm>|thanks to <firm> we have chairs|the mayor of <place> cut the ribbon|Half of <place> came.|<place> is lovely in May.|We drove through <place> at night.|Next stop <place>.|A week in <place>, then home.|The <place> fair opens <date>.|Rain in <place>, sun in <place>.|The old mill outside <place> burned.|Roads around <place> flooded.
<firm> is hiring.|<firm> moved next to <firm>.|I bought the <thing> at <firm>.|The bus stops behind <firm>.|<firm> closes at <time>.|Do you know <firm>?|The party is in <firm>.|<firm> has a new sign.|My bank is across from <firm>.|<firm> sponsors the team.|A fire broke out at <firm>.|<firm> and <firm> merged.|we stayed at <firm>|<firm>, <place>|Coupons from <firm> expired.|The <firm> has no lift.|The <firm> serves tea.|Live jazz in the <firm>.|<firm> sells the best <thing> in <place>.
Turn left on <streetonly>, past the chapel.|The parade goes down <streetonly>.|<streetonly> is being paved.|The corner of <streetonly> and <streetonly> floods.|Trees along <streetonly> were cut.|There is no parking on <streetonly>.|The tram on <streetonly> broke down.|She grew up around <streetonly>.|Buskers on <streetonly> play till <time>.|Shops line <streetonly>.|Wir treffen uns in der <streetonly>.|Cortaron la <streetonly>.|La <streetonly> est barrée.
Order <code> shipped.|your order number is <code>|Invoice no. <code> is overdue.|invoice <code>|Booking <code> was cancelled.|Booking reference: <code>|Ticket <code> was refunded.|Reservation code <code>|Tracking <code> shows no movement.|Parcel <code> is at the depot.|Membership <code> lapsed.|loyalty number <code>|Loyalty points on card <code> vanished.|library card <code>|gift card <code>|Serial no. <code> is on the back.|Model <code> is discontinued.|Part <code> fits both pumps.|article <code>, two pieces|SKU: <code>|ISBN <code>|Case <code> is still open.|Policy <code> was renewed.|Receipt <code>, cash.|Voucher <code> is void.|Confirmation <code>|Ref. <code>|our reference <code>|stock item <code>|Flight <code> boards at <time>.|Gate <num>, seat <num>C.|Room <num> is upstairs.|Batch <code> was recalled.|lot <code>|Bestellung <code> fehlt.|Rechnung <code> ist bezahlt.|Pedido <code> retrasado.|Factura <code> pagada.|Commande <code> perdue.|Facture <code> réglée.|Réservation <code>|Reserva <code>|meter reading <code>|account balance <price>|The score was <num>-<num>.|<num>/<num> of the votes.|<num>.<num> percent.|Chapter <num>, page <num>.|We need <num> <thing>, not <num>.|the year <year>|founded in <year>|version <num>.<num>.<num>|ratio <num>:<num>|size <num>x<num>|<num> km in <num> minutes|born <date>|<date> <time>|between <year> and <year>
<num> Hours of music.|<num> Dalmatians barked.|Top <num> Places to swim.|<num> Ways to fold a map.|In <year> Queen and country changed.|The <num> Bus is late.|<num> Stars over the hill.|Lesson <num> Verbs.|Room <num> Window seat.|<num> bags of flour on the way home.|<num> years down the road.|the last <num> days drive me mad|<num> cars on a narrow lane|about <num> people walk there|we had <num> guests in one place
<Thing> first, then sugar.|<Thing> grows by the shed.|<Thing> and <thing> belong together.|<Thing> is my favourite colour.|A <thing>-coloured scarf.|The <thing> bush needs pruning.|a pinch of <thing>|<thing> oil and <thing> soap|<thing> tea with honey|<Thing> trees line the yard.|fresh <thing> from the garden|the scent of <thing>|Her eyes are <thing>.|a ring of <thing>|<THING> ON SALE|an <thing> lamp|We mixed <thing> and <thing> in a jar.|The walls are <thing> now.|<Thing>: three bunches.|<Thing>-free soap|The <thing> glaze cracked.|<Thing> soup again?|With <thing> it smells <adj>.
Monday is laundry day.|In April the lake thaws.|English or Spanish, both are fine.|The Easter break is short.|On Fridays we rehearse.|Summer came early.|Please ring twice.|Bring your own cup.|Never mind.|Good luck!|Well done.|See you soon.|Not today.|Anyway, it works now.|Also, mind the step.|Thank you all.|Sorry for the noise.|Many greetings to everyone.|Dear neighbours,|Dear parents,|Hello everyone,|Hi team,|Good morning,|To whom it may concern,|Dear customer,|Love this lamp.|Best wishes for the move.|Yours is the blue one.|Best of all, it floats.|Cheers to that!|Thanks for nothing.|Regards from the coast.|Signed copies are gone.|Contact: see below.|Name: unknown.|Customer: none|The manager was <adj>.|Our teacher is <adj>.|My neighbour has a <thing>.|The driver, tired as ever, left.|The nurse said no.|Ask for a map at the desk.|Go and fetch the <thing>.|Call me later.|Text me when you land.|My phone died.|Write to us soon.|They live by the sea.|The passport office is shut.|I lost my licence.|Tax day is near.|The security guard waved.|National parks are free.|My address book is full.|Send it home.|Mail arrives at <time>.|The number was busy.|Mr and Mrs moved out.|The doctor is in.
El <thing> está en la caja.|La clase empieza a las <num>.|Llueve en <place> desde el lunes.|Compré <num> sillas por <price>.|Mi hermana pinta la pared.|¿Dónde está el <made>?|Nos gusta <place>.|Muchas gracias por todo.|Buenos días a todos,|El tren de <place> llega tarde.|La tienda <firm> cerró.|Hay que regar el <thing>.|Un café con leche.|Volvemos el <date>.|No funciona la lámpara.|El jefe no vino.|Saludos desde <place>.
Der <thing> steht im Keller.|Die Probe beginnt um <time>.|In <place> schneit es.|Wir brauchen <num> Stühle.|Der Zug nach <place> hat Verspätung.|Das <made> klemmt wieder.|Vielen Dank für alles.|Guten Morgen zusammen,|Meine Schwester streicht die Wand.|Bei <firm> gibt es Farbe.|Der Hund schläft im Garten.|Die Rechnung kommt später.|Das Fenster ist offen.|Alle Kinder haben Ferien.|Der Chef war nicht da.|Grüße aus <place>.|Am <date> ist Feiertag.|Die Straße ist gesperrt.|Ein Brot und zwei Eier.
Le <thing> est dans la cave.|La répétition commence à <time>.|Il neige à <place>.|Il faut <num> chaises.|Le train de <place> est en retard.|Le <made> est coincé.|Merci pour tout.|Bonjour à tous,|Ma sœur peint le mur.|Chez <firm> on trouve de tout.|Le chien dort au jardin.|La fenêtre est ouverte.|Les enfants sont en vacances.|Le patron était absent.|Un salut de <place>.|Retour le <date>.|La rue est barrée.|Quel beau <thing> !
We drove to <place> for the <thing>.|They flew to <place>.|Back to <place> by bus.|Let us go to <place>.|He moved to <place>.|I walk to <place> every day.|The way to <place> is long.|She sailed to <place> and back.|How far is it to <place>?|a trip to <place>|The pupils in <place> learn chess.|Farmers in <place> say no.|He was seen in <place>, close to the dam.|In <place> the shops close early.|In <place>, nobody skis.|The bridge in <place>, behind the church, fell.|Fuimos a <place> en coche.|Vamos a <place> mañana.|Llegamos a <place> de noche.|En <place> hace sol.|Wir fahren nach <place>.|zurück nach <place>|Das Museum in <place> ist neu.|Für <place> gibt es Schnee.|On part à <place>.|Retour à <place> ce soir.|Les rues de <place> sont vides.|La plage de <place> est longue.|Où est <place> ?|Le maire de <place> parle.|La mairie de <place> ferme.|Le curé de <place> chante.|Une école de <place> brûle.|El alcalde de <place> renunció.|La alcaldesa de <place> habló.|El museo de <place> abre.|Los vecinos de <place> protestan.|Der Bürgermeister von <place> schwieg.|Die Lehrer von <place> streiken.|The vicar of <place> sings.|a baker from <place>|MAPS OF <place>|The schools around <place> have <num> buses each.
Hm.|Ugh.|Yikes!|Whew.|Bah.|Hmm, no.|Yep.|Nope.|Ouch!|<Made>.|<Made>!|Wow.|Oops, sorry.|Huh?|Vale.|Claro.|Genau.|Doch!|Voilà.|Bof.|Danke für die Blumen.|Danke euch allen.|Gracias por venir.|Merci bien.|Höhe der Leiter: knapp.|Breite: <num> cm.|Vamos pronto.|Compramos <thing> y <made>.|Bailamos hasta las <num>.|Comimos <made> y <made> en casa.|Queremos <made>.|Nadamos en el lago.|Salimos temprano.|Esperamos <num> minutos.|Hubo <made> con <made>.|Quizás llueva.|Wollen wir <made>?|Wäre das <made> da.|Zuerst das <made>, dann <made>.|Könnte klappen.|Übrigens fehlt ein <thing>.|Nous avons <made> et <made>.|Quelle <made> !|Voici le <made>.|J'aime le <made>.|L'été arrive.|D'abord le <made>.|C'était <adj>.
THE <THING> SHELF HOLDS <num> JARS.|A <MADE> SHOW FOR KIDS.|NO <MADE> TODAY|BEWARE OF THE <MADE> DOG|THE <MADE> MACHINE (WITH <THING>) RUNS <num> HOURS.|<thing>-based paint|<thing>-style boots|<THING>-STYLE BOOTS|a <thing>-<adj> mix|<thing>-like smell|<thing>-<made> blend|the <thing>-tinted glass|<Thing>-tinted, <adj>.|very <thing> and <adj>|It was <thing>, then <adj>.|so <thing>!|The wall: <thing>. The door: <adj>.|Everything is <thing>.|Is it <thing> or <adj>?|rather <thing> overall|too <thing>|The door: <thing>-<adj>.|The lid: <thing>-dyed.|Our clerk: <thing>-faced.|Dentist: <thing>-<adj>.|<Thing> or <thing>?|<Thing> with <thing>, please.|<Thing> and <thing> on one shelf, with <thing>.|<Thing> and <thing> in the attic.|<Thing>, <thing> and <thing>.|<Thing> and <adj> <thing>.|No <thing>, no <thing>.|The <made> <made> (with <thing>) stays.|a <thing> <made> (<adj>)|the <made> <made> (<num>)|<thing> <made>, (see below)|find it at <made>.example|look at www.<made>.com/<made>|shown at www.<made>.example today|a bit <thing>|The <thing>: <adj>.|Our <thing> was <thing> and <adj>.|The <thing> felt <thing>.|I find the <thing> <thing>.|<num> times <thing>
@home with a cold|meet @ <num>|price @ <price>|see www.<made>.example/<made>|http://<made>.example/a?b=<num>|follow @<made>|at noon dot dot dot|we were at lunch|look at this dot|#<made> #<made>|<num> eggs @ <price>|at <made> dot street level|10:30 @ the pier|C# and F# are hard|<b><Thing></b> and <i>more</i>|<p>The <thing> is <adj>.</p>|A&amp;B printed it.|**Note**: <thing>|* <thing>/* <thing>|1) <thing> 2) <thing>|"<Thing>" means <adj>.|(<thing>, <thing>)|<adj>... <adj>!!!|LOL :-)|<thing>?!
Thé <thíng> wás nót thére.|Évery <made> wás <adj>.|The <made> <made> with <made> <made>.|<Made> powder.|The <Made> engine.|<Made> is a brand of glue.|<Made> (the card game) sold out.|A <Made> T-shirt.|The play <Made> was <adj>.|Model <Made> has <num> gears.|The river <Made> rose.|Mount <Made> is steep.|Lake <Made> froze.|The <Made> choir sings.|our <Made> sofa|the <Made> sauce|a bottle of <Made>|We drank <Made>.
"""

# Ordinary words; the first line's are first names, too.
ORDINARY = "Amber Basil Rose Ginger Hazel Iris Olive Pepper Copper Daisy Lily Violet Ruby Jasmine Heather Ivy Clement Sage Pearl Crystal Holly Rusty Penny".split()
_THINGS = "lamp shelf ladder rug pillow kettle drawer bucket hammer bench curtain violin drum pencil paint wool candle broom mirror basket bottle window bicycle tent rope stove engine tile jacket boot scarf blanket bread soup cheese rice noodle salad sauce coffee milk cake".split()
_ADJ = "good bad old new broken shiny heavy light dull bright noisy calm cheap dear narrow wide soft rough dry wet cold warm sweet bitter salty fine odd plain lovely awful quick slow".split()
_STREETS = "St|Street|Rd|Road|Ave|Avenue|Ln|Lane|Dr|Drive|Blvd|Way|Ct|Court|Pl|Place|Terrace|Square|Parkway|Circle|Crescent|Close|Walk|Row|Trail|Alley".split("|")
_TOWNS = "Springs Falls Bay Hills Flats Ridge Wells Mills Valley Harbor Cove Heights Creek".split()
_TOWN_ENDS = "ton ham ville burg ford haven field marsh mouth dale port wick by stead moor brook town water".split()
_FIRMS = "Grill Bistro Hotel Cafe Kitchen House Tavern Diner Bar Bakery Garage Salon Inn Pub Market Shop Clinic Studio Deli Gallery Pharmacy Laundry Brewery".split()
_HOSTS = "post letters inbox mailbox webmail home office school club choir team web my net corp".split()
_TOPS = "com org net edu info io co.uk de fr es example test invalid".split()
_COMMON_GIVEN = "Anna Peter Maria John Lucy Oscar Elena Hugo Clara Felix Nora Simon Julia Marta Paul Greta Luis Carmen Hans Ingrid Claire Pierre Sofia Mark Ellen Thomas Laura David Karen Amir Mei Kofi Yuki Olga Ivan Leila Omar".split()
_COMMON_FAMILY = "Smith Miller Garcia Lopez Schmidt Weber Dubois Martin Rossi Novak Kowalski Jensen Larsen Silva Costa Tanaka Chen Patel Khan Brown Wilson Clark Young Fischer Moreau".split()


class Filler:
    """Rules that fill the slots of a row, from one seed."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        self.given = [*ORDINARY, *_COMMON_GIVEN, *(self.made(True) for _ in range(150))]
        self.family = [*_COMMON_FAMILY, *(self.surname() for _ in range(200)), "Copper", "Pepper", "Baker", "Brook", "Field"]
        # a list of names is never complete: some two in three are on it
        self.on_list = {n.lower(): part for part, names in (("G", self.given), ("F", self.family)) for n in names if self.r.random() < 0.66 or n in ORDINARY and self.r.random() < 0.7}

    def d(self, n: int) -> str:
        return "".join(self.r.choices("0123456789", k=n))

    def made(self, cap: bool = False) -> str:
        r = self.r
        heads, cores = ["b", "br", "k", "kl", "t", "tr", "v", "st", "m", "n", "r", "l", "d", "f", "gr", "s", "sh", "h", "w", "qu", "j", "z", "p", "pl", "c", "ch", ""], ["a", "e", "i", "o", "u", "ia", "ea", "oo", "ai", "y", "ou"]
        word = "".join(r.choice(heads) + r.choice(cores) for _ in range(r.choice([1, 2, 2, 2, 3]))) + r.choice(["", "", "n", "r", "s", "lk", "nd", "rt", "x", "ne", "l", "m", "ck", "th"])
        word = word if len(word) > 2 else word + "ra"
        return word.capitalize() if cap else word

    def surname(self) -> str:
        r = self.r
        return self.made(True) + r.choice(["", "son", "sen", "man", "well", "wood", "smith", "er", "ski", "ez", "worth", "hurst", "berg", "ard", "ley", "stone", "feld", "ova", "bridge"])

    def name(self) -> str:
        r = self.r
        g, f, k = r.choice(self.given), r.choice(self.family), r.random()
        i = r.choice("ABCDEFGHJKLMNOPRSTVW") + "."
        if k < 0.24:
            out = g
        elif k < 0.33:
            out = f
        elif k < 0.6:
            out = f"{g} {f}"
        elif k < 0.68:
            out = f"{g} {i} {f}"
        elif k < 0.77:
            out = f"{g} {f}-{r.choice(self.family)}"
        elif k < 0.85:
            out = f"{f}, {g}"
        elif k < 0.92:
            out = f"{i} {f}"
        elif k < 0.94:
            out = f"{i}{r.choice('ABCDEFGHJKLM')}. {f}"
        elif k < 0.96:
            out = f"{g} {r.choice(['de', 'van', 'von', 'de la', 'da'])} {f}"
        elif k < 0.98:
            out = f"{g} {r.choice(self.given)} {f}"
        else:
            out = f"{g}-{r.choice(self.given)} {f}"
        c = r.random()
        return out.lower() if c < 0.05 else out.upper() if c < 0.1 else out

    def email(self) -> str:
        r = self.r
        g, f, n = r.choice(self.given).lower(), r.choice(self.family).lower(), r.randint(1, 99)
        local = r.choice([f"{g}.{f}", f"{g}{n}", f"{g[0]}{f}", f"{f}+{self.made()}", f"{g}_{f}{n}", f"{g}-{f[:3]}", f"{g}.{f}{n}", g, f"{self.made()}{n}", f"{f}.{g[0]}", f"info.{self.made()}"])
        host = r.choice([self.made(), f"{self.made()}{r.choice(['mail', 'post', 'net', ''])}", f"{r.choice(_HOSTS)}.{self.made()}", f"{self.made()}-{r.choice(_HOSTS)}"]) + "." + r.choice(_TOPS)
        k = r.random()
        if k < 0.62:
            out = f"{local}@{host}"
        else:
            at = r.choice(["(at)", " (at) ", "[at]", " [at] ", " at ", " @ ", "＠"])
            dot = {" at ": " dot ", "(at)": ".", "＠": ".", " @ ": "."}.get(at) or r.choice([".", " (dot) " if "(" in at else " [dot] "])
            out = local + at + host.replace(".", dot)
        return out.upper() if r.random() < 0.1 else out

    def phone(self) -> str:
        r, d = self.r, self.d
        area, s = r.choice("23456789") + d(2), r.choice([" ", "-", ".", " – ", "/"])
        return r.choice([
            lambda: f"({area}) {d(3)}-{d(4)}", lambda: f"({area}){d(3)}-{d(4)}", lambda: f"({area}){d(7)}", lambda: f"({area}) {d(3)} {d(4)}", lambda: f"{area}{s}{d(3)}{s if s != '/' else '-'}{d(4)}", lambda: f"{area}-{d(3)}-{d(4)}", lambda: f"{area}.{d(3)}.{d(4)}",
            lambda: f"+1 {area} {d(3)} {d(4)}", lambda: f"+1-{area}-{d(3)}-{d(4)}", lambda: f"+1 ({area}) {d(3)}-{d(4)}", lambda: f"+1{area}{d(7)}", lambda: f"1-{area}-{d(3)}-{d(4)}", lambda: f"{area}{d(7)}", lambda: f"{r.choice('2345')}{d(2)}-{d(4)}",
            lambda: f"0{d(2)} {d(4)} {d(4)}", lambda: f"0{d(4)} {d(3)} {d(3)}", lambda: f"0{d(4)} {d(6)}", lambda: f"0{d(4)} {d(3)}{d(3)}", lambda: f"0{d(3)} {d(3)} {d(4)}", lambda: f"+44 {d(4)} {d(6)}", lambda: f"+44 20 {d(4)} {d(4)}", lambda: f"+44 (0){d(4)} {d(6)}",
            lambda: f"0{r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"0{r.randint(1, 9)}.{d(2)}.{d(2)}.{d(2)}.{d(2)}", lambda: f"+33 {r.randint(1, 9)} {d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+49 {d(2)} {d(5)} {d(3)}", lambda: f"+49 {d(3)} {d(7)}", lambda: f"0{d(2)} {d(5)} {d(3)}", lambda: f"0{d(2)}/{d(7)}", lambda: f"0{d(3)}-{d(6)}",
            lambda: f"+34 {d(3)} {d(3)} {d(3)}", lambda: f"+34 {d(3)} {d(2)} {d(2)} {d(2)}", lambda: f"{r.choice('6789')}{d(2)} {d(3)} {d(3)}", lambda: f"{r.choice('6789')}{d(2)} {d(2)} {d(2)} {d(2)}", lambda: f"+{r.randint(30, 99)} {d(2)} {d(3)} {d(4)}", lambda: f"00{r.randint(30, 99)} {d(2)} {d(7)}",
        ])()

    def letters(self, n: int) -> str:
        return "".join(self.r.choices("ABCDEFGHJKLMNPRSTVWXYZ", k=n))

    def ssn(self) -> str:
        s = self.r.choice(["-", "-", "-", " ", ".", ""])
        return f"{self.d(3)}{s}{self.d(2)}{s}{self.d(4)}"

    def passport(self) -> str:
        r = self.r
        return r.choice([lambda: self.letters(1) + self.d(7), lambda: self.letters(1) + self.d(8), lambda: self.letters(2) + self.d(7), lambda: self.d(9), lambda: self.letters(1) + self.d(6), lambda: self.letters(3) + self.d(6), lambda: self.letters(1) + " " + self.d(7)])()

    def tax(self) -> str:
        r = self.r
        return r.choice([lambda: f"{self.d(2)}-{self.d(7)}", lambda: self.d(11), lambda: f"{self.d(2)} {self.d(3)} {self.d(3)} {self.d(3)}", lambda: f"{self.d(3)}/{self.d(3)}/{self.d(5)}", lambda: f"{self.d(3)}-{self.d(2)}-{self.d(4)}", lambda: self.d(10), lambda: f"{self.letters(1)}{self.d(8)}", lambda: self.d(9)])()

    def licence(self) -> str:
        r = self.r
        return r.choice([lambda: f"{self.letters(1)}{self.d(7)}", lambda: f"{self.letters(1)}{self.d(3)}-{self.d(4)}-{self.d(4)}", lambda: f"{self.letters(1)}-{self.d(3)}-{self.d(3)}-{self.d(3)}", lambda: f"{self.letters(1)}-{self.d(2)}-{self.d(2)}-{self.d(4)}", lambda: f"{self.d(3)}-{self.d(3)}-{self.d(3)}", lambda: f"{self.letters(1)}{self.d(12)}", lambda: f"{self.letters(2)}{self.d(6)}", lambda: f"{self.d(8)}", lambda: f"{self.letters(1)}{self.d(2)}-{self.d(6)}"])()

    def national(self) -> str:
        r = self.r
        return r.choice([lambda: f"{self.d(8)}{self.letters(1)}", lambda: f"{self.d(8)}-{self.letters(1)}", lambda: f"{r.choice('XYZ')}{self.d(7)}{self.letters(1)}", lambda: f"{self.letters(2)} {self.d(2)} {self.d(2)} {self.d(2)} {self.letters(1)}", lambda: f"{self.letters(2)}{self.d(6)}{self.letters(1)}", lambda: f"{self.d(7)}{self.letters(1)}", lambda: self.d(12), lambda: f"{r.choice('12')} {self.d(2)} {self.d(2)} {self.d(2)} {self.d(3)} {self.d(3)} {self.d(2)}", lambda: self.d(9), lambda: f"{self.letters(1)}{self.d(8)}", lambda: f"{self.d(6)}-{self.d(4)}"])()

    def code(self) -> str:
        """Numbers of things, in forms of any kind, those of persons' numbers among them."""
        r, d, a = self.r, self.d, self.letters
        return r.choice([
            lambda: d(r.randint(5, 12)), lambda: d(r.randint(6, 10)), lambda: d(8), lambda: f"{a(r.randint(1, 3))}{d(r.randint(4, 8))}", lambda: f"{a(r.randint(1, 3))}-{d(r.randint(4, 7))}", lambda: f"{a(1)}{d(r.randint(3, 5))}-{d(r.randint(2, 3))}", lambda: "-".join(d(r.randint(1, 5)) for _ in range(r.randint(2, 4))), lambda: f"{d(4)}-{d(r.randint(2, 4))}-{d(4)}",
            lambda: f"{d(r.randint(2, 4))}-{d(r.randint(3, 5))}-{d(r.randint(1, 2))}", lambda: f"{d(4)} {d(4)} {d(4)}", lambda: f"20{d(2)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(2)}", lambda: f"{d(4)}/{d(4)}", lambda: f"{d(6)}{a(1)}", lambda: f"#{d(6)}", lambda: f"{a(2)} {d(3)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"20{d(2)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}", lambda: self.ssn(), lambda: self.tax(), lambda: self.licence(),
        ])()

    def streetname(self) -> str:
        r = self.r
        return r.choice([lambda: self.made(True), lambda: self.made(True), lambda: f"{self.made(True)} {self.made(True)}", lambda: f"{r.choice(['Old', 'New', 'North', 'West', 'Upper', 'Saint', 'E', 'S.'])} {self.made(True)}", lambda: f"{r.choice(['North', 'East', 'South', 'W'])} {r.randint(2, 90)}th", lambda: f"{r.randint(4, 90)}th", lambda: r.choice(["Oak", "Maple", "Church", "Mill", "Park", "Station", "High", "Cedar", "King", "River"])])()

    def street(self) -> str:
        return f"{self.streetname()} {self.r.choice(_STREETS)}"

    def foreign(self, number: bool) -> str:
        r = self.r
        n, k = (str(r.randint(1, 199)) + r.choice(["", "", "", " bis", "b"])) if number else "", r.random()
        word = r.choice([self.made(True), self.made(True), self.made(True) + " " + self.made(True), "Vieux " + self.made(True)])
        if k < 0.34:
            return f"{n}{r.choice([' ', ', ']) if n else ''}{r.choice(['rue', 'rue', 'avenue', 'place', 'chemin', 'boulevard', 'quai', 'allée', 'impasse'])} {r.choice(['de la ', 'du ', 'des ', 'de ', 'de l’', 'd’', ''])}{word}"
        if k < 0.67:
            return f"{r.choice(['Calle', 'Calle', 'Camino', 'Avenida', 'Plaza', 'Paseo', 'Ronda', 'C/'])} {r.choice(['del ', 'de la ', 'de los ', 'de ', '', '', 'Tres '])}{word}{r.choice([' Viejo', '', '', '', ' Alta'])}{r.choice([' ', ' ', ', ']) + n.replace(' bis', '') if n else ''}"
        return f"{r.choice(['', '', '', 'Alte ', 'Am ', 'Neue '])}{self.made(True)}{r.choice(['straße', 'str.', 'weg', 'gasse', 'allee', 'platz', 'damm', 'ufer', 'strasse'])}{' ' + n.replace(' bis', '') if n else ''}"

    def address(self) -> str:
        r, n = self.r, str(self.r.randint(1, 9999))
        if r.random() < 0.6:
            n = r.choice([n, n, n, n, f"{r.randint(1, 300)}-{r.choice('ABCD')}", f"{r.randint(1, 300)}{r.choice('ABcd')}"])
            unit = r.choice(["", "", "", "", f", {r.choice(['Apt', 'Apt.', 'Unit', 'Suite', 'Flat', 'Ste', 'apartment'])} {r.randint(1, 40)}{r.choice(['', '', 'B'])}", f" {r.choice(['Apt', 'Unit', 'Suite'])} {r.randint(1, 40)}", f" #{r.randint(1, 40)}", f", #{r.randint(1, 40)}"])
            out = f"{n} {self.street()}{unit}"
        else:
            out = self.foreign(True)
        c = r.random()
        return out.lower() if c < 0.05 else out.upper() if c < 0.1 else out

    def thing(self) -> str:
        return self.r.choice(ORDINARY).lower() if self.r.random() < 0.45 else self.r.choice(_THINGS)

    def place(self) -> str:
        r = self.r
        return r.choice([lambda: self.made(True), lambda: f"{self.made(True)}{r.choice(_TOWN_ENDS)}", lambda: f"{self.made(True)}{r.choice(_TOWN_ENDS)}", lambda: f"{self.made(True)} {r.choice(_TOWNS)}", lambda: f"{r.choice(_THINGS).capitalize()}{r.choice(_TOWN_ENDS)}", lambda: f"{r.choice(_THINGS + ORDINARY).capitalize()} {r.choice(_TOWNS)}", lambda: f"{r.choice(['Port', 'Mount', 'San', 'Saint', 'Bad', 'Fort', 'Lake', 'New'])} {self.made(True)}"])()

    def firm(self) -> str:
        r = self.r
        n = r.choice([r.choice(ORDINARY), r.choice(self.given), r.choice(self.family), self.made(True), r.choice(_THINGS).capitalize()])
        return r.choice([lambda: f"{n} {r.choice(_FIRMS)}", lambda: f"{n} {r.choice(_FIRMS)}", lambda: f"{n}'s {r.choice(_FIRMS)}", lambda: f"{n}'s", lambda: f"The {n} {r.choice(_FIRMS)}", lambda: f"{n} & {r.choice(['Sons', 'Co', r.choice(self.family), r.choice(ORDINARY)])}", lambda: f"{r.choice(_ADJ).capitalize()} {n} {r.choice(_FIRMS)}", lambda: f"{n} {r.choice(self.family)} {r.choice(_FIRMS)}", lambda: f"{r.choice(_FIRMS)} {n}"])()

    def date(self) -> str:
        r = self.r
        y, m, d = r.randint(1990, 2029), r.randint(1, 12), r.randint(1, 28)
        return r.choice([f"{d}/{m:02}/{y}", f"{y}-{m:02}-{d:02}", f"{d}.{m}.{y}", f"{m:02}-{d:02}-{y}", f"{d} May", f"June {d}, {y}", f"{m}/{d}/{y % 100:02}"])

    def slot(self, key: str) -> tuple[str, str | None]:
        """(text, kind or None)"""
        r = self.r
        if key in ("ssn", "passport", "tax", "licence", "national"):
            return getattr(self, key)(), "id_number"
        if key in KINDS:
            return getattr(self, key)(), key
        plain: dict[str, Callable[[], str]] = {
            "thing": self.thing, "thíng": self.thing, "Thing": lambda: self.thing().capitalize(), "THING": lambda: self.thing().upper(), "MADE": lambda: self.made().upper(), "made": self.made, "Made": lambda: self.made(True), "adj": lambda: r.choice(_ADJ) if r.random() < 0.85 else r.choice(ORDINARY).lower(),
            "num": lambda: str(r.choice([r.randint(2, 12), r.randint(2, 99), r.randint(100, 999), r.randint(2, 60)])), "year": lambda: str(r.randint(1850, 2030)), "time": lambda: r.choice([f"{r.randint(1, 12)}:{self.d(1)}5", f"{r.randint(1, 12)} {r.choice(['am', 'pm'])}", f"{r.randint(0, 23)}:00", f"{r.randint(1, 12)}{r.choice(['am', 'pm'])}"]),
            "price": lambda: r.choice([f"${r.randint(1, 999)}", f"{r.randint(1, 99)}.{self.d(2)} €", f"${r.randint(1, 99)}.{self.d(2)}", f"€{r.randint(1, 999)}", f"{r.randint(2, 99)} euros", f"£{r.randint(1, 9)},{self.d(3)}"]), "date": self.date, "place": self.place, "firm": self.firm, "code": self.code,
            "streetonly": lambda: self.street() if r.random() < 0.7 else self.foreign(False),
        }
        return plain[key](), None

    def fill(self, sentence: str) -> tuple[str, list[tuple[int, int, str]]]:
        text, spans = "", []
        for i, part in enumerate(sentence.split("<")):
            if i:
                key, end, rest = part.partition(">")
                if end and (key in KINDS or key in SLOTS):
                    value, kind = self.slot(key)
                    if kind:
                        spans.append((len(text), len(text) + len(value), kind))
                    text, part = text + value, rest
                else:
                    text += "<"
            text += part
        return text, spans

    def led_name(self) -> str:
        """A sentence about a name after a title or a role, put together from lists."""
        r = self.r
        k, roles = r.random(), CUES["role"].split()
        deed = r.choice(DEEDS) if r.random() < 0.5 else r.choice(["<made> the <thing>", "<made> <made>", "<made> <num> <thing>s", "<made> <Made>", "<made> le <made>", "<made> den <Made>", "<made> <made> <made>", "is <adj>", "has a <adj> <thing>", "<made>t", "and the <thing> were <adj>", "<made> un <thing>"])
        if k < 0.4:
            title = r.choice(["Mr.", "Mr", "Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Dr.", "Dr", "Prof.", "Professor", "Herr", "Frau", "Señor", "Señora", "Sr.", "Sra.", "Doña", "Monsieur", "Madame", "Mme", "Mlle", "M.", "Herr Dr."])
            return r.choice([f"{title} <name> {deed}.", f"{title} <name> {deed}.", f"I asked {title} <name> twice.", f"Dear {title} <name>,", f"{deed.capitalize()}: {title} <name>", f"for {title} <name>"])
        det, role = r.choice(BEFORE_ROLE), r.choice(roles)
        if k < 0.75:
            return r.choice([f"{det.capitalize()} {role} <name> {deed}.", f"{det} {role} <name> {deed}", f"{det.capitalize()} {role}, <name>, {deed}.", f"Yesterday {det} {role} <name> {deed}.", f"{role.capitalize()} <name> {deed}.", f"We thanked {det} {role} <name>.", f"<name>, {det} {role}, {deed}.", f"{role.capitalize()}: <name>"])
        if k < 0.85:
            return r.choice([f"<name> {r.choice(DEEDS)}.", f"<name> {r.choice(DEEDS)}!", *[f"{r.choice(OPENERS)} <name> {r.choice(DEEDS)}."] * 4, f"{r.choice(OPENERS)} <name>"])
        # the same without a name
        return r.choice([f"{det.capitalize()} {role} {deed}.", f"{det.capitalize()} {role} from <place> {deed}.", f"{det.capitalize()} {role} with the <made> hat {deed}.", f"{det.capitalize()} <Made> {role} {deed}.", f"{role.capitalize()} needed at <firm>.", *[f"{det.capitalize()} {role} {r.choice(['de', 'de', 'of', 'von', 'du', 'in', 'à', 'en'])} <place> {deed}."] * 2])


SLOTS = frozenset("ssn passport tax licence national thing thíng Thing THING made Made MADE adj num year time price date place firm code streetonly".split())


def sentences(text: str) -> list[str]:
    return [s.replace("/<", "\n<").replace("/*", "\n*") for line in text.strip().splitlines() for s in line.split("|")]


def labelled_rows(rows: int, seed: int = 20, carriers: list[str] | None = None, names: list[str] | None = None, others: list[str] | None = None) -> tuple[list[tuple[str, list[tuple[int, int, str]]]], dict[str, str]]:
    """(text, spans) of so many rows, and the list of names that goes with them (lower case -> G given or F family). Other
    sentences than the module's own may be given, for tests."""
    f = Filler(seed)
    own = carriers is None
    carriers, names, others = carriers or sentences(CARRIERS), names or sentences(NAMES), others or sentences(OTHERS)
    out = []
    for k in range(rows):
        chosen = [carriers[(k // 2) % len(carriers)] if k % 2 else names[(k // 2) % len(names)]]
        chosen += f.r.choices(others, k=f.r.choice([1, 2, 3, 4]))
        if own and f.r.random() < 0.5:
            chosen.append(f.led_name())
        if f.r.random() < 0.15:
            chosen.append(f.r.choice(carriers))
        f.r.shuffle(chosen)
        gap, text, spans, case = f.r.choice([" ", " ", " ", "\n", "\n\n", "<br>"]), "", [], f.r.random()
        for s in chosen:
            t, found = f.fill(s)
            c = f.r.random()
            if c < 0.05 and len(t) > 3:
                a, b = f.r.choice([("<p>", "</p>"), ("<b>", "</b>"), ("**", "**"), ("- ", ""), ("> ", ""), ("“", "”")])
                t, found = a + t + b, [(x + len(a), y + len(a), kind) for x, y, kind in found]
            if (case < 0.09 or 0.94 < c < 0.97) and len(t.upper()) == len(t):
                t = t.upper()
            elif case > 0.97 and len(t.lower()) == len(t):
                t = t.lower()
            text += gap if text else ""
            spans += [(x + len(text), y + len(text), kind) for x, y, kind in found]
            text += t
        out.append((text, spans))
    return out, f.on_list
