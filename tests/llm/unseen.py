"""Sentences that the recognizer is not trained on; slots as in orebody.llm.pii_table. The first three lists, about sport,
health and trade, were looked at while the training table was written; the FRESH ones, about farms, music and law, were not."""

CARRIERS = """
The physio answers under <email> on weekdays.|Race results: <email>|Please confirm via e-mail (<email>) by Sunday.|My work account <email> was hacked.|<email>, in case the form fails|send the invoice over to <email> instead|La clínica usa <email>.|Rückfragen bitte an <email>|Pour les tickets : <email>|He signs up everywhere as <email>.
If the coach is late, phone <phone>.|The surgery moved, new number <phone>.|Boat rental, tel <phone>|My sister uses <phone> abroad|We waited for a call from <phone>.|Taxi: <phone>|mobile <phone>|El taller atiende en el <phone>.|Die Praxis ist unter <phone> erreichbar.|Le garage répond au <phone>.|Try <phone> before nine.|contact number <phone>
The customs form shows passport <passport>.|They photocopied my driving licence <licence>.|social security number: <ssn>|Her SSN <ssn> was on the chart.|For the race permit they asked my tax number <tax>.|national identity card <national>|The pharmacy kept my ID (<national>).|mi pasaporte, <passport>, venció|Mein Personalausweis: <national>|numéro de sécurité sociale <ssn>|tax ID: <tax>|I was told to bring passport no. <passport> to the gate.|licence <licence> was suspended
The clinic mailed the bill to <address>.|We rent a cottage at <address>.|Her shop is at <address>.|the courier went to <address> instead|new address: <address>|Team bus picks us up at <address>.|La fisio vive en <address>.|Die Praxis liegt <address>.|Le vétérinaire habite au <address>.|Ship the skis to <address>!|registered at <address> since 2011|They stored my bike at <address>.
Waxing:/<name>/<phone>|Kind regards,/<name>|<name> (physio), <phone>|customer <name>, <address>|Skipper: <name> - <email>|<name> swims, her mail is <email>.
"""

NAMES = """
The goal by <name> came late.|Midfield was run by <name>.|Doctor's note for <name>|I met <name> at the regatta.|Then <name> dropped the baton.|We love <name>!|<name> stitched me up.|Ask <name>, the coach.|Our physio <name> is patient.|The vet, <name>, was gentle.|Mr. <name> sold us the boat.|Mrs. <name> refused to pay.|Dr. <name> took an x-ray.|Frau <name> verkauft Skier.|Señora <name> vende bicicletas.|Mme <name> répare des vélos.|Greetings, <name>|Yours, <name>|Signed: <name>|My name is <name> and I row.|passenger: <name>|Name of patient: <name>|the skipper was <name>|Thanks <name>, great massage.|thanks to <name> we won|Danke <name> für das Training.|Gracias <name> por el masaje.|Merci <name> pour la course.|Ich fahre mit <name>.|Je cours avec <name>.|Corro con <name>.|<name> scored twice.|<name> and I paddled home.|What does <name> think?|Our cashier <name> mixed up the bill.|I complained to <name> at the counter.|Hi <name>, any slots left?|the lifeguard <name> waved
"""

OTHERS = """
The <thing> set was sold out.|Try the <made> massage, it is <adj>.|A <adj> <thing> costs <price> here.|I ran <num> laps in <place>.|The marathon in <place> starts at <time>.|<firm> rents boats.|The gym next to <firm> is <adj>.|Parking on <streetonly> is free.|Booking <code> was doubled.|Order <code> came without screws.|Invoice <code> attached.|member no <code>|Ticket <code> for the final.|Article <code> is back.|The boat takes <num> people.|<num> tablets a day.|<Thing> balm helps.|<thing> salve for the knee|Training is on Tuesday.|The nurse was <adj>.|Our coach left.|Do not wait for me.|We won.|El <thing> es <adj>.|El partido en <place> se aplazó.|Das Spiel in <place> fiel aus.|Der <thing> kostet <price>.|Le match à <place> est reporté.|Le <thing> coûte <price>.|Great views over <place>.|The <made> run is for beginners.|Season pass <price>, day pass <price>.|The lift in <place> is closed until <date>.|A <Made> board and <Made> boots.|The <firm> team lost.|Sold at <firm> for <price>.|lap <num> of <num>|Score: <num>:<num>.|My doctor says rest.|All welcome at <firm>.|it was <thing> all over|Physio first, then sauna.|What a race!
"""

FRESH_CARRIERS = """
Orchestra bookings through <email> only.|The attorney prefers <email>.|seed catalogue: <email>|Eggs can be ordered at <email> or in the yard.|Bewerbungen an <email> senden|La orquesta ensaya; avisos en <email>.|Our beekeeper, <email>, has honey.|Avocat : <email>
The tractor driver answers on <phone>.|Rehearsal cancelled? Dial <phone>.|hearing room telephone <phone>|Vet on duty: <phone>|<phone> (barn)|El abogado contesta en el <phone>.|Der Anwalt hat die Nummer <phone>.|La ferme : <phone>|text us: <phone>
The court file lists passport <passport>.|Witness gave social security <ssn>.|tax ID <tax> on the lease|His driving licence is <licence>.|ID card <national> was seized.|número de pasaporte: <passport>|Reisepass <passport> liegt vor.|carte nationale d'identité <national>|The deed names tax number <tax>.
The hay goes to <address>.|Cellist wanted, rehearsals at <address>.|the defendant lived at <address> until May|farm shop, <address>|the summons was sent to <address>|La granja está en <address>.|Der Hof liegt <address>.|La ferme se trouve <address>.|Drop the cello off at <address>, thank you.
Witness:/<name>/<address>|For the farm,/<name>|<name> (cello), <phone>|plaintiff: <name>, <email>
"""

FRESH_NAMES = """
The judge heard <name> first.|<name> milks the goats at dawn.|Second violin: <name>|The verdict surprised <name>.|I lent <name> my bow.|Mr. <name> grows leeks.|Ms. <name> pleaded guilty.|Frau <name> spielt Geige.|Señor <name> cría cabras.|Monsieur <name> plaide demain.|Our conductor <name> was ill.|The farmer, <name>, shrugged.|Our lawyer <name> objected.|thanks to <name> for the tomatoes|Best, <name>|signed by <name>|Hello <name>, the hay is dry.|my name is <name>|Then <name> sang.|Is <name> the new drummer?|accused: <name>|Wir danken <name>.|Gracias <name>.|Merci à <name> pour les œufs.|Ask <name> about the harvest.|The song is by <name>.|<name> played the drums.|<name>, who sold the calf, left early.
"""

FRESH_OTHERS = """
The <thing> concerto was <adj>.|Court opens at <time>.|The harvest in <place> failed.|<num> goats escaped.|A <made> harp costs <price>.|The trial moved to <place>.|<firm> buys our milk.|Gigs at <firm> start late.|The barn on <streetonly> leaks.|docket <code>|seed order <code> is on its way|invoice <code> for straw|Ticket <code>, balcony.|<Thing> honey sells well.|dried <thing> and <thing>|We play on Sunday.|The judge was <adj>.|No further questions.|Applause!|Im Stall steht ein <thing>.|Das Urteil fällt in <place>.|La cosecha de <place> es <adj>.|El juez llegó.|Le juge est parti.|La récolte de <place> est bonne.|Sheep graze near <place>.|The <Made> waltz opens the night.|Case dismissed on <date>.|Rehearse bar <num> again.|My lawyer is <adj>.|a <thing>-<adj> cow|The jury: <adj>.
"""
