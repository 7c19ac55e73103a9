"""A small labelled table: pages as flat lines, each marked + for main content or - for page furniture.

Written by hand for this purpose after the usual shapes of web pages (news, recipe, blog, documentation,
shop guide, forum, letter), not taken from any corpus. A line of the table that is only ``.`` is a blank line.
Each page has a language and a style, so that either can be held out.
"""

from __future__ import annotations

import random

# The labelled table. A page begins with "= language style".
TABLE = """
= en news
- Skip to content
- World
- Business
- Sport
- Video
.
+ # Ferry strike enters second week
.
- Jane Doe, transport correspondent
- Updated 3 hours ago
.
+ Thousands of commuters were left waiting on the quays on Monday after talks between the operator and its crews broke down again.
.
+ The company said it had made what it called a final offer, while the union described the proposal as a step backwards. Neither side has named a date for further talks.
.
- ADVERTISEMENT
.
+ ## What the crews want
.
+ The dispute turns on rest hours. Crews are asking for eleven hours between shifts, which the operator says would take two vessels out of service.
+ > We are not asking for the moon, we are asking for sleep.
+ > — a deckhand
.
+ *The quay at noon, March 9. Piet Visser*
.
- More on this story: [Harbour board meets in private](/harbour-board)
.
+ Passengers with tickets for this week can travel on the night boat or ask for their money back at the counter.
.
- Share on Facebook
- Share by email
.
- ## Top stories
- 1. Bus fares to rise in autumn
- 2. Mayor opens new quay
- 3. Fog closes airport
.
- Copyright 2021 Coast Herald Ltd
- Terms and conditions | Privacy notice | Accessibility
= en blog
- Home / Blog / Garden
.
+ Growing beans on a balcony
.
- Posted on 12 March by Tom in Garden
.
+ I have tried for three summers to grow runner beans in pots, and this year it worked. Here is what I changed.
.
+ - Bigger pots, at least forty centimetres deep.
+ - Water every evening rather than every morning.
+ - A net instead of canes, because of the wind.
.
+ The first flowers came in June. By the middle of July I was picking a bowl every other day, and the neighbours had begun to hide when they saw me coming.
.
+ *The pots in the first week of July. Photo by the author.*
.
- If you liked this post, buy me a coffee.
- Never miss a post: enter your email and press the button
.
- Tags: beans, balcony, pots
- 14 responses
- Post a comment
.
- Older posts
- Newer posts
.
- Proudly made with a free theme. RSS feed
= en guide
- [Shop](/shop) | [Guides](/guides) | [Basket (0)](/basket)
.
+ # How to choose a bicycle pump
.
- We may receive a small fee if you order via our links.
.
+ A pump should do two things: reach the pressure printed on your tyre, and fit the valve. Everything else is comfort.
.
+ | Type | Pressure | Weight |
+ |---|---|---|
+ | Floor pump | 11 bar | 1.4 kg |
+ | Frame pump | 7 bar | 120 g |
.
+ ### Valves
.
+ 1. Car valves are wide and have a spring inside.
+ 2. Racing valves are narrow and have a small nut that must be opened first.
.
+ If you are not sure which one you have, look at the cap. [The Cycle Museum](https://museum.example/valves) – a page with drawings of every valve made since 1890.
.
- Customers also viewed
- [Mini pump, black](/p/1)
- [Tyre levers, set of 3](/p/2)
- [Repair kit](/p/3)
.
- Delivery and returns | Help | Store finder
- All prices include tax. Registered in England no. 123456.
= en docs
- Docs > Reference > Queues
- On this page
- Search docs
.
+ # Queues
.
+ A queue holds work that has been accepted and not yet started. Workers take the oldest entry first.
.
+ ```
+ queue = Queue(limit=10)
+ queue.put("job")
+ print(queue.get())
+ ```
.
+ When the limit is reached, `put` waits until a worker has taken an entry. Set the limit to zero for a queue without one.
.
+ ## Errors
.
+ Taking from an empty queue raises an error unless a timeout is given.
.
- Was this page helpful? Yes / No
- Edit this page
- « Pools   |   Retries »
.
- Last updated on 2 Feb 2022
= en letter
- View this email in your browser
.
+ # Five things we learned about tides
.
+ Good morning. It has been a strange week by the sea, and there is a lot to tell you about.
.
+ The tide tables for the estuary were printed with the wrong year on the cover. Nobody noticed until a schoolteacher tried to use one, and the printer has now promised to replace all four hundred copies.
.
- Presented by Blue Anchor Insurance
.
+ Elsewhere, the lighthouse has a new lamp. It uses less power than a kettle and can be seen from eighteen miles away, according to the engineer who fitted it.
.
+ That is all for this week. The next letter will be about mud.
.
- Forward this letter to a colleague
- Unsubscribe | Update preferences | Read online
- You get this because you signed up on our site.
- Our postal address is 4 Quay Road, Port Ellen
= en magazine
- We use cookies so that our site works and to see how it is used. Read our cookie statement.
- Allow all
- Manage
.
- Sign in
- Become a member
.
+ The quiet return of the night train
.
- Words by Anna Berg
- 9 min read
.
+ Some time after midnight the train stops in a field. Nobody knows why. A man in the corridor says that it is because of the cows, and a woman with a violin says that it is always because of the cows.
.
+ Twenty years ago there were forty such trains. Then there were six. Now, to the surprise of the people who run them, there are thirty again, and every bed is taken.
.
- You might be interested in: A month without flying
.
+ **“We thought the sleeping car was finished,” the manager told me.** She has worked for the line since she was nineteen, and she remembers the last day of the old service.
.
+ The privacy of a compartment is part of it, she thinks; nobody on board asks you to accept anything, log in or follow anyone. “You close the door and that is that,” she said.
.
+ The railway's terms and conditions run to ninety pages, and a passenger once read all of them to the guard between two stops.
.
+ *Carriage four, July 1. Iris Chen*
.
+ In the morning there is coffee, and a menu printed on one sheet of paper.
.
- This feature appeared in our spring issue.
- The opinions in this article belong to its writer.
- Get our best features by email every Friday. No ads, cancel whenever you want.
.
- READ NEXT
- The last tram driver – Elena Ruiz
- A station without a town – Sam Oyelaran
- Sleeping on rails: a short history – Iris Chen
.
- About | Advertise | Careers | Press
- No part of this site may be copied without consent from the publisher.
= en forum
- Register
- Log in
- Forum index › Repairs
.
+ Clock runs fast after cleaning
.
+ I cleaned a wall clock that belonged to my aunt and now it gains ten minutes a day. Before that it was fine. What have I done?
.
+ You have probably shortened the pendulum without meaning to. Turn the nut at the bottom to the left, one full turn for each half minute a day.
.
+ That was it, thank you! It is now right to within a few seconds.
.
- Reply
- Report this post
- 3 people found this useful
.
- Similar threads
- Cuckoo does not come out
- Where to buy a mainspring
.
- Powered by an open source board
- Contact the moderators: mods@clocks.example
= en local
- Council
- Bins
- Roads
- Schools
- Parks
- Libraries
.
+ # Library to open on Sundays
.
+ From April the central library will open its doors on Sundays for the first time since 1974.
.
+ The council voted for the change by eleven votes to nine. “It was close, but it was right,” the chair said afterwards.
.
- Sponsored content
.
+ Staff will be asked to volunteer for the new hours and will be paid one and a half times the usual rate. The footer of the council paper, which says that nothing in it is final, was read out twice by a member of the opposition.
.
+ ## In numbers
.
+ - 412 people signed the petition
+ - 36 letters were written against it
.
+ *Main hall, May 2. Council archive*
.
+ 1. Hart, oak shelves
+ 2. Moss, reading lamps
.
- Send us your views: newsdesk@local.example
- Like us on social media
.
- Most viewed this week
- Road closed for film crew
- Swan found in car park
.
- Part of the Regional Papers network
- Cookie policy
- Back to top ↑
= en ideas
+ # Why maps lie, and why we need them to
.
- Maria Costa – 4 May 2020
.
+ No flat map can show a round world without stretching it somewhere. The question is only where to put the stretching.
.
+ Sailors want straight lines, so they accept a Greenland the size of Africa. Teachers want true areas, so they accept continents that look as if they had been hung out to dry.
.
+ 1. A map that keeps angles
+ 2. A map that keeps areas
+ 3. A map that keeps neither, but looks right
.
+ Share your favourite with a child and ask what is wrong with it; the answers are better than the textbook.
.
- Next article → How long is a coast?
- ← Last article
.
- This text is for general information only and does not replace professional help.
- © Maria Costa
= de news
- Zum Inhalt springen
- Politik
- Wirtschaft
- Sport
- Mediathek
.
+ # Fähre bleibt im Hafen
.
- Von unserer Redakteurin Eva Kern
- Aktualisiert am 3. Mai, 14:20 Uhr
.
+ Auch am Montag fuhr keine einzige Fähre über den Fluss. Die Gespräche zwischen der Reederei und den Besatzungen waren am Wochenende ohne Ergebnis zu Ende gegangen.
.
+ Die Reederei sprach von einem letzten Angebot, die Gewerkschaft von einem Rückschritt. Einen neuen Termin gibt es bisher nicht.
.
- ANZEIGE
.
+ ## Was die Besatzungen fordern
.
+ Es geht um die Ruhezeiten. Elf Stunden sollen zwischen zwei Schichten liegen, bisher sind es neun.
+ > Wir wollen nicht den Mond, wir wollen schlafen.
+ > — ein Matrose
.
+ *Am Kai, 9. März. Piet Visser*
.
- Lesetipp: [Hafenamt tagt hinter verschlossenen Türen](/hafenamt)
.
- Artikel per E-Mail versenden
- Auf Facebook teilen
.
- Beliebte Artikel
- Busse werden im Herbst teurer
- Nebel legt Flughafen lahm
.
- © Küstenbote GmbH
- Datenschutzhinweise | Nutzungsbedingungen | Barrierefreiheit
= de blog
- Start / Blog / Garten
.
+ Bohnen auf dem Balkon
.
- Veröffentlicht am 12. März von Tom
.
+ Drei Sommer lang habe ich versucht, Bohnen in Töpfen zu ziehen, und in diesem Jahr hat es endlich geklappt.
.
+ - Größere Töpfe, mindestens vierzig Zentimeter tief.
+ - Gießen am Abend und nicht am Morgen.
.
+ Im Juni kamen die ersten Blüten. Mitte Juli habe ich jeden zweiten Tag eine Schüssel voll gepflückt.
.
+ *Die Töpfe Anfang Juli. Foto: privat*
.
- Keinen Beitrag verpassen: E-Mail-Adresse eintragen und bestätigen
- Wenn Ihnen unsere Arbeit etwas wert ist, werden Sie Mitglied
.
- Stichwörter: Bohnen, Balkon
- 14 Antworten
- Kommentar schreiben
- Ältere Beiträge
- Neuere Beiträge
= de magazin
- Wir setzen Cookies ein, damit unsere Seite funktioniert und um ihre Nutzung auszuwerten. Mehr dazu in der Datenschutzerklärung.
- Alles erlauben
- Auswahl treffen
.
- Einloggen
- Registrieren
.
+ Die leise Rückkehr des Nachtzugs
.
- Ein Text von Anna Berg
- Lesedauer: 9 Minuten
.
+ Irgendwann nach Mitternacht hält der Zug auf freiem Feld. Niemand weiß, warum. Ein Mann im Gang sagt, es liege an den Kühen.
.
+ Vor zwanzig Jahren gab es vierzig solcher Züge. Dann waren es sechs. Heute sind es wieder dreißig, und jedes Bett ist belegt.
.
- Weiterlesen: Ein Monat ohne Flugzeug
.
+ „Wir dachten, der Schlafwagen sei am Ende“, sagte die Leiterin. Sie arbeitet seit ihrem neunzehnten Lebensjahr für die Linie.
.
+ Die Nutzungsbedingungen der Bahn haben neunzig Seiten; ein Fahrgast las sie dem Schaffner einmal vor.
.
+ 1. Kern, Schlafwagen
+ 2. Ruiz, Speisewagen
.
+ Am Morgen gibt es Kaffee und eine Speisekarte auf einem einzigen Blatt Papier. Wer will, kann das Menü auch teilen, sagt der Kellner, aber das wolle selten jemand.
.
- Dieser Text stammt aus unserer Frühlingsausgabe.
- Beiträge geben die Meinung der Verfasser wieder.
- Abonnieren Sie unseren Newsletter und lesen Sie jeden Freitag die besten Texte.
.
- WEITERE BEITRÄGE
- Der letzte Straßenbahnfahrer – Elena Ruiz
- Ein Bahnhof ohne Stadt – Sam Oyelaran
.
- Über das Magazin | Werben | Karriere | Presse
- Vervielfältigung nur mit Genehmigung des Verlags.
= fr news
- Aller au contenu
- Monde
- Économie
- Sport
- Vidéos
.
+ # Le bac reste à quai
.
- Jeanne Petit, service transports
- Mis à jour le 3 mai à 14 h 20
.
+ Des milliers de voyageurs ont encore attendu lundi sur les quais, après l'échec des discussions entre la compagnie et ses équipages.
.
+ La compagnie parle d'une dernière offre, le syndicat d'un recul. Aucune date n'a été fixée pour reprendre les pourparlers.
.
- PUBLICITÉ
.
+ ## Ce que demandent les équipages
.
+ Tout tient aux heures de repos. Les équipages veulent onze heures entre deux services, contre neuf aujourd'hui.
+ > Nous ne demandons pas la lune, nous demandons à dormir.
+ > — un matelot
.
+ *Sur le quai, 9 mars. Piet Visser*
.
- Lire également : [Le conseil du port se réunit à huis clos](/conseil)
.
- Envoyer par courriel
- Suivez-nous sur les réseaux sociaux
.
- Les articles les plus consultés
- Le prix du bus augmente à l'automne
- Le brouillard ferme l'aéroport
.
- Copyright Le Courrier de la Côte
- Conditions d'utilisation | Protection des données | Accessibilité
= fr blog
- Accueil / Journal / Jardin
.
+ Des haricots sur un balcon
.
- Publié le 12 mars par Thomas
.
+ J'ai essayé trois étés de suite de faire pousser des haricots en pot, et cette année j'ai enfin réussi.
.
+ - Des pots plus grands, d'au moins quarante centimètres.
+ - Arroser le soir plutôt que le matin.
.
+ Les premières fleurs sont venues en juin. À la mi-juillet, je cueillais un bol tous les deux jours.
.
+ *Les pots au début de juillet. Photo de l'auteur.*
.
- Inscrivez-vous à notre lettre d'information, gratuite et sans engagement
- Faites un don pour nous aider à continuer
.
- Étiquettes : haricots, balcon
- 14 réponses
- Laisser un commentaire
- Articles plus anciens
= fr revue
- Nous utilisons des cookies pour faire fonctionner le site et analyser sa fréquentation. Consultez notre politique en matière de cookies.
- Tout autoriser
- Gérer mes choix
.
- Se connecter
- S'abonner
.
+ Le retour discret du train de nuit
.
- Texte d'Anna Berg
- Temps de lecture : 9 minutes
.
+ Un peu après minuit, le train s'arrête en pleine campagne. Personne ne sait pourquoi. Un homme dans le couloir dit que c'est à cause des vaches.
.
+ Il y a vingt ans, on comptait quarante trains de ce genre. Puis il n'y en eut plus que six. Ils sont de nouveau trente, et chaque lit est pris.
.
- À découvrir : Un mois sans avion
.
+ « Nous pensions que la voiture-lit était finie », m'a dit la directrice, qui travaille pour la ligne depuis l'âge de dix-neuf ans.
.
+ Le règlement de la ligne compte quatre-vingt-dix pages, et un voyageur l'a lu tout entier au contrôleur.
.
+ ## Comment on dort
.
+ 1. Kern, voiture-lit
+ 2. Ruiz, voiture-bar
.
+ Le matin, on sert du café et un menu imprimé sur une seule feuille.
.
- Les propos tenus ici n'engagent que leur auteur.
- Cet article a paru dans notre numéro de printemps.
.
- À LIRE ENSUITE
- Le dernier conducteur de tramway – Elena Ruiz
- Une gare sans ville – Sam Oyelaran
.
- Qui sommes-nous | Publicité | Recrutement | Presse
- Aucune reproduction sans l'autorisation de l'éditeur.
= es news
- Saltar al contenido
- Mundo
- Economía
- Deportes
- Vídeos
.
+ # El ferry sigue en el puerto
.
- Juana Pérez, redactora de transportes
- Actualizado el 3 de mayo a las 14:20
.
+ Miles de viajeros volvieron a esperar el lunes en los muelles, después de que fracasaran las conversaciones entre la compañía y sus tripulaciones.
.
+ La compañía habla de una última oferta y el sindicato de un paso atrás. Nadie ha puesto fecha a la próxima reunión.
.
- PUBLICIDAD
.
+ ## Lo que piden las tripulaciones
.
+ Todo gira en torno al descanso. Piden once horas entre dos turnos, y hoy tienen nueve.
+ > No pedimos la luna, pedimos dormir.
+ > — un marinero
.
+ *En el muelle, 9 de marzo. Piet Visser*
.
- Le puede interesar: [La junta del puerto se reúne a puerta cerrada](/junta)
.
- Enviar por correo
- Síganos en las redes sociales
.
- Las noticias más vistas
- Sube el precio del autobús en otoño
- La niebla cierra el aeropuerto
.
- Copyright El Heraldo de la Costa
- Condiciones de uso | Protección de datos | Accesibilidad
= es blog
- Portada / Blog / Jardín
.
+ Judías en un balcón
.
- Publicado el 12 de marzo por Tomás
.
+ Durante tres veranos intenté cultivar judías en macetas, y este año por fin lo he conseguido.
.
+ - Macetas más grandes, de al menos cuarenta centímetros.
+ - Regar por la tarde y no por la mañana.
.
+ Las primeras flores llegaron en junio. A mediados de julio recogía un cuenco cada dos días.
.
+ *Las macetas a principios de julio. Foto del autor.*
.
- Reciba nuestro boletín gratis en su correo
- Hágase socio y ayúdenos a seguir
.
- Temas: judías, balcón
- 14 respuestas
- Deje un comentario
- Entradas antiguas
= es revista
- Utilizamos cookies para que el sitio funcione y para analizar su uso. Consulte nuestra política de cookies.
- Permitir todas
- Elegir
.
- Iniciar sesión
- Suscribirse
.
+ El regreso callado del tren nocturno
.
- Texto de Anna Berg
- 9 minutos de lectura
.
+ Poco después de medianoche el tren se detiene en medio del campo. Nadie sabe por qué. Un hombre en el pasillo dice que es por las vacas.
.
+ Hace veinte años había cuarenta trenes así. Luego quedaron seis. Ahora vuelven a ser treinta y todas las camas están ocupadas.
.
- Siga leyendo: Un mes sin avión
.
+ «Creíamos que el coche cama se había acabado», me dijo la directora, que trabaja en la línea desde los diecinueve años.
.
+ Las condiciones de uso del tren tienen noventa páginas, y un viajero se las leyó enteras al revisor.
.
+ ## Cómo se duerme
.
+ 1. Kern, coche cama
+ 2. Ruiz, coche bar
.
+ Por la mañana sirven café y un menú impreso en una sola hoja.
.
- Las opiniones publicadas aquí son de sus autores.
- Este texto salió en nuestro número de primavera.
.
- OTROS ARTÍCULOS
- El último conductor de tranvía – Elena Ruiz
- Una estación sin ciudad – Sam Oyelaran
.
- Quiénes somos | Publicidad | Empleo | Prensa
- No se permite la copia sin autorización de la editorial.
= en interview
- Home
- Interviews
- About
.
+ # A conversation with a bell founder
.
- Interview: Paul Reed
.
+ Ruth Okafor has cast bells for thirty-one years, first in her father's yard and now in a hall of her own.
.
+ > A bell is never finished, it is only hung.
+ > — Ruth Okafor
.
+ *Whitby, June 4. Paul Reed*
.
+ What she remembers of the first one is the smell.
.
+ > You can hear a bad mould before you open it.
+ > – her father
.
+ Customers write to her from everywhere, and she answers every letter by hand. A website would be nice, she says, with a shop and a search box, but who would read the comments?
.
+ ### Tools of the yard
.
+ 1. Okafor, wooden ladle
+ 2. Reed, brass ruler
+ 3. Vane, clay press
.
+ *Okafor – the old furnace, 1962*
.
- ## Recommended for you
- 1. The last of the rope makers – Craft Weekly
- 2. How an organ breathes – Craft Weekly
- 3. Two sisters and a loom – Craft Weekly
.
- Topics: bells, craft, metal
- 5 readers have commented
- Craft Weekly is brought to you by Moor House, 12 Mill Lane, Leeds
- Ask us anything: hello@craft.example
= en report
- We and our partners use cookies to improve your experience on our site. Choose your settings.
- Accept cookies
- More options
.
- [Start](/) > Water > Reports
.
+ # Where the water goes
.
- By Lena Hart, staff writer, 2019-04-11
.
- Like this report? Tell others about it
.
+ In 2018, the works at Elm Cross lost a third of what they pumped, and two villages lost their supply for nine days.
.
+ - [Elm Cross works](https://water.example/elm) – The pumps here were built in 1931 and still run on Sundays.
+ - [Lower mill](https://water.example/mill) – A single keeper looks after forty kilometres of pipe.
.
- Advertising
.
+ ## The bill
.
+ | Village | Loss |
+ |---|---|
+ | Elm Cross | 31 |
+ | Dunley | 12 |
.
+ ```
+ loss = read("meters")
+ for row in loss.rows():
+     print(row.village)
+ ```
.
+ Who pays? The district says that the company pays; the company says that customers do.
.
- See more: When the well ran dry
.
+ The report, all 212 pages of it, was printed on the kind of paper that is used for menus.
.
- ## Editor's picks
- [When the well ran dry – Water Review](https://review.example/well)
- [A dam in the desert – Water Review](https://review.example/dam)
.
- Water Review does not give investment advice.
- Links to shops may be paid for.
- Republishing needs the written agreement of the editors.
- First printed in Water Review no. 14.
- Like our work? Become a supporter
- © 2019 Water Review. Some rights reserved.
- Terms | Privacy | Cookies | Contact
- You can change your cookie choices whenever you like.
= en notes
+ Notes from a small harbour
.
- Written by Joan Hale | Harbour Notes | 4 min
.
+ By the end of the week the boats were back and the nets hung on the wall. “We [the crew] slept for a day,” one of them said [3].
.
+ The sign above the door says “closed for ever”, and has said so since it opened.
.
+ ## What is left
.
+ Twelve boats, a crane and a good deal of rope.
.
- Keep reading: [The crane](/crane)
.
+ - One boat was sold to a museum without its engine.
+ - Two were broken up for their timber.
.
- Spread the word: send Harbour Notes to someone you like
- Get Harbour Notes by post every month
- **In this series**
- A rope for every day – Joan Hale
- The man who painted boats – Joan Hale
.
- Comments are closed
- Harbour Notes, Pier 3, Whitstable
= de bericht
- Diese Website verwendet Cookies und ähnliche Techniken. Einige sind nötig, andere helfen uns.
- Cookies akzeptieren
- Nur notwendige
.
- [Start](/) > Wasser > Berichte
.
+ # Wohin das Wasser geht
.
- Von Lena Hart, Redaktion, 2019-04-11
.
+ Das Werk in Ulmen verlor 2018 ein Drittel von dem, was es pumpte, und zwei Dörfer saßen neun Tage auf dem Trockenen.
.
+ > Man hört das Wasser, bevor man es sieht.
+ > — Ruth Amsel
.
+ *Ulmen, 4. Juni. Paul Ried*
.
+ - [Werk Ulmen](https://wasser.example/ulmen) – Die Pumpen stammen von 1931 und laufen noch am Sonntag.
.
+ Wer zahlt? Der Kreis sagt, die Firma; die Firma sagt, die Kunden.
.
- Auch interessant: Als der Brunnen leer war
.
- Gefällt Ihnen der Bericht? Erzählen Sie anderen davon
- ## Empfehlungen der Redaktion
- 1. Als der Brunnen leer war – Wasserblatt
- 2. Ein Damm in der Wüste – Wasserblatt
.
- Das Wasserblatt gibt keine Anlageberatung.
- Bezahlte Links sind gekennzeichnet.
- Abdruck nur nach schriftlicher Zusage.
- Wasserblatt, Mühlweg 12, Leer
- Schreiben Sie uns: post@wasser.example
- © 2019 Wasserblatt. Alle Rechte beim Verlag.
- AGB | Datenschutz | Cookies | Kontakt
= fr rapport
- Ce site et ses partenaires utilisent des cookies. Certains sont nécessaires, d'autres nous aident à l'améliorer.
- Accepter les cookies
- Plus d'options
.
- [Accueil](/) > Eau > Rapports
.
+ # Où va l'eau
.
- Par Léna Hart, rédaction, 2019-04-11
.
+ En 2018, l'usine d'Ormes a perdu le tiers de ce qu'elle pompait, et deux villages sont restés neuf jours à sec.
.
+ > On entend l'eau avant de la voir.
+ > — Ruth Amsel
.
+ *Ormes, 4 juin. Paul Ried*
.
+ - [Usine d'Ormes](https://eau.example/ormes) – Les pompes datent de 1931 et tournent encore le dimanche.
.
+ Qui paie ? Le canton dit que c'est la société ; la société dit que ce sont les clients.
.
- Pour aller plus loin : Quand le puits fut vide
.
- Ce rapport vous a intéressé ? Parlez-en autour de vous
- ## Le choix de la rédaction
- 1. Quand le puits fut vide – La Feuille d'eau
- 2. Un barrage au désert – La Feuille d'eau
.
- La Feuille d'eau ne donne pas de conseils de placement.
- Les liens rémunérés sont signalés.
- Reproduction soumise à un accord écrit.
- La Feuille d'eau, 12 chemin du Moulin, Ormes
- Nous écrire : courrier@eau.example
- © 2019 La Feuille d'eau. Droits réservés.
- CGU | Confidentialité | Cookies | Contact
= es informe
- Este sitio y sus socios usan cookies. Unas son necesarias y otras nos ayudan a mejorarlo.
- Aceptar cookies
- Más opciones
.
- [Inicio](/) > Agua > Informes
.
+ # Adónde va el agua
.
- Por Lena Hart, redacción, 2019-04-11
.
+ En 2018 la planta de Olmos perdió un tercio de lo que bombeaba y dos pueblos se quedaron nueve días sin agua.
.
+ > El agua se oye antes de verse.
+ > — Ruth Amsel
.
+ *Olmos, 4 de junio. Paul Ried*
.
+ - [Planta de Olmos](https://agua.example/olmos) – Las bombas son de 1931 y aún funcionan los domingos.
.
+ ¿Quién paga? La comarca dice que la empresa; la empresa dice que los clientes.
.
- Más información: Cuando se secó el pozo
.
- ¿Le gustó el informe? Cuénteselo a otros
- ## Selección de la redacción
- 1. Cuando se secó el pozo – La Hoja del Agua
- 2. Una presa en el desierto – La Hoja del Agua
.
- La Hoja del Agua no da consejos de inversión.
- Los enlaces pagados están señalados.
- Para reproducir hace falta un acuerdo escrito.
- La Hoja del Agua, calle Molino 12, Olmos
- Escríbanos: cartas@agua.example
- © 2019 La Hoja del Agua. Derechos reservados.
- Términos | Privacidad | Cookies | Contacto
= en error
- Home | Shop | Help
.
+ The page you asked for could not be opened.
+ Error 404
.
- © Corner Store
= en error
+ This site works only with scripts switched on. Please change the setting in your browser and load the page again.
.
- Cookie policy
= de error
- Start | Hilfe
.
+ Diese Seite gibt es leider nicht.
.
- Datenschutz
= en filler
- Menu
- Search
.
+ # Your heading goes here
.
+ Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor incididunt ut labore et dolore magna aliqua.
.
- Subscribe
- All rights reserved
"""

Page = list[tuple[str, bool | None]]


def table() -> list[tuple[str, str, Page]]:
    """(language, style, page): the lines of each page with True for furniture, False for content, None for blank lines."""
    out: list[tuple[str, str, Page]] = []
    for line in TABLE.strip().split("\n"):
        if line[:1] == "=":
            _, language, style = line.split()
            out.append((language, style, []))
        else:
            out[-1][2].append(("", None) if line == "." else (line[2:], line[0] == "-"))
    return out


def pages(n: int = 600, seed: int = 11, keep=lambda language, style: True) -> list[Page]:
    """The pages of the table that ``keep`` admits, and variants of them up to ``n`` pages; the same for the same arguments.

    A variant has the furniture before and behind the body of another page of its language, lacks some
    lines, and wears its furniture as converters do: in capitals, bold or italic letters, as list items or quotes, without blank lines.
    """
    r = random.Random(seed)
    held = [(language, page) for language, style, page in table() if keep(language, style)]
    out = [page for _, page in held][:n]

    def body(page: Page) -> tuple[int, int]:
        own = [k for k, (_, furniture) in enumerate(page) if furniture is False]
        return own[0], own[-1] + 1

    def worn(line: str) -> str:
        kind = r.random()
        if kind < 0.7 or line[:1] in "[|>#*-":
            return line
        return line.upper() if kind < 0.8 else r.choice(["*{}*", "**{}**", "> {}", "- {}"]).format(line)

    while len(out) < n:
        language, page = r.choice(held)
        other = r.choice([p for own, p in held if own == language])
        (a, b), (c, d) = body(page), body(other)
        before = other[:c] if r.random() < 0.5 else page[:a]
        behind = other[d:] if r.random() < 0.5 else page[b:]
        main = page[a:b]
        if r.random() < 0.4 and len(main) > 12:
            main = main[: r.randint(8, len(main))]
        made: Page = []
        for part, drop, tight in ((before, r.choice([0.0, 0.3, 0.8]), r.random() < 0.3), (main, r.choice([0.0, 0.1]), False), (behind, r.choice([0.0, 0.3, 0.8]), r.random() < 0.3)):
            for line, furniture in part:
                if furniture is None:
                    if not tight:
                        made.append(("", None))
                elif r.random() >= drop:
                    made.append((worn(line) if furniture else line, furniture))
        if any(f is False for _, f in made):
            out.append(made)
    return out
