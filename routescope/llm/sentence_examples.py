"""Hand-labelled training text for the sentence model: a bar stands behind the last character of each sentence.

Written for this model from general knowledge of the languages: gardens, ships, kitchens, weather and trains. It shares
no text with the test tables.
"""

from __future__ import annotations

EXAMPLES = [
    # plain ends; with no, one or two spaces, over line breaks, over blank lines, without a last mark
    "The gate was open.| The dog ran out.| We called him back.|",
    "A train left at noon.| It was full.|\nAnother came at one.|\nIt was empty.|",
    "The bread rose slowly over\nthe whole of the night and\nwas baked at dawn.| It tasted good.|",
    "We closed the shop.|The street was quiet.|Rain fell.|", "The boat sank.|  Its crew swam home.|  Nobody drowned.|",
    "Tools were counted (n = 12).|The shed was locked.|", "Prices rose by 7.|Then they fell.|", "It closed at 9.| The lights went out.|",
    "Gardening\n\nWe planted beans in spring.| They grew well.|", "The first part ends.|\n\nMaterials\n\nWood was used.| Glue was used.|", "A good start\n\nThe door opens.|",
    "The road is long.| The night is cold and", "Many birds sang\n\nThey flew off.| One stayed", "It was done. |\nThe next day began.|".replace(". |", ".| "),
    # numbers: decimals, versions, times, ends after a number
    "The tank held 42.5 litres.| It cost 1.250,75 euros.| Version v3.11.2 runs.|", "Add .25 of a cup.| Stir for 3,600.5 seconds.| The share was 0.33.| Then came 12.|",
    "The odds were 1.4 (0.9 to 2.2).| They did not change.|", "We walked 8 km.| 14 of 30 guests came.| 5 stayed.|", "It happened in 1987.| The town grew.| By 2004. it had doubled.|".replace("2004. it", "2004 it"),
    "The bus was no. 44.| It came late.| Bus no. 7 came early.|", "Mix 2.5 spoons with 0.4 l of milk.| Bake at 180.| Wait.|", "He paid 3.| She paid 4.|",
    # codes and symbols as subjects, at ends, small letters first
    "It was built after RX20.| Ten men worked there.| They used model KT7.| It broke.|", "The lamp is an LED5.| 30 of 60 lamps failed.|", "The part was called QV81.| S. Moor drew it.|",
    "pH fell at once.| mRNA was found.| iPhone sales rose.| eBay grew.|", "The team chose xTB9.| zRK2 was kept.| The rest used aLM4.| nothing was lost.|".replace("nothing", "Nothing"), "Was it kept?| pDNA was lost.| The plane landed!| eJet sales rose.|",
    "It was sold (see ZN40).| qPCR came later.| The ratio was 6.4.| tRNA rose.|",
    # initials of names
    "J. Moor wrote it.| A. B. Stone and C. D. Field read it.| The book was by E. Lake.|", "We met T. R. Wood.| He spoke of G. Hill.| M. N. Reed agreed.|", "The paper is by P. Q. Marsh and Prof. Rock.| R. S. Dale printed it.|",
    "It rained all day.| L. M. Ford stayed in.|\nH. K. West went out.|", "The prize went to O. Banks.| Class B.| The vitamin is C.| It helps.|".replace("Class B.| ", ""), "Rain fell (1 mm).| W. Frost left.| V. Snow came.|",
    # titles and words before names
    "Dr. Lane met Prof. Rivers.| They talked.| Mr. Hill and Mrs. Dale came.| Ms. Moor left.|", "We asked Dr. Stone.| St. Mary stood there.| Gen. Price spoke to Capt. Cook and Lt. Gray.|", "Rev. Poole and Hon. Judge Park came with Sen. Wood.| Gov. Hall spoke.| Sgt. Pike slept.|",
    "Herr Dr. Baum und Fr. Blum kamen.| Hr. Feld ging.| Prof. Stein blieb.|", "M. Dubois parle.| Mme. Petit chante.| Le Dr. Blanc et MM. Noir et Roux dorment.|", "El Sr. Campo y la Sra. Rosa cantan.| La Dra. Luna habla.| El Dr. Mar y la Srta. Paz callan.| Ud. sabe.|",
    # references and counts before a number
    "See Fig. 4 and Figs. 5 and 6.| It is in Vol. 2, No. 9, pp. 30 to 35.| Look at p. 7 of Sec. 3.|", "Eq. 2 gives Tab. 8.| Ch. 11 follows.| Ref. 5 was lost (Fig. 1).| Art. 6 stands.|", "The plan (Fig. 7) shows No. 3.| No. 12 is far away.|",
    "Siehe Abb. 3 und Tab. 4.| Nr. 9 fehlt (Abb. 6).| Auf S. 20 steht Bd. 2.| Kap. 5 beginnt.|", "Voir fig. 3 et tab. 2.| La page p. 8 manque (fig. 9).| Le no. 6 arrive.|", "Véase fig. 2 y tabla 3.| El núm. 5 falta (fig. 8).| En la pág. 9 sigue.|", "См. рис. 5 и табл. 2.| На стр. 7 есть рис. 9.| Гл. 3 начата.| Дом на ул. Мира стоит.|",
    # words that link: small letters, capitals, codes and numbers follow and nothing ends
    "The cat vs. the mouse was fun.| Red vs. Blue drew.| It ran vs. KR5 and vs. 30 others.|", "It took approx. 20 days.| Some fruit, e.g. pears, kept.| Use a tool, e.g. TX4, or e.g. 3 nails.| The boss, i.e. Ann, left.| It is i.e. 5 or i.e. green.|",
    "Cf. the map.| It is old (cf. Moor).| It was ca. 1900 and ca. .5 m wide.| It is est. 40 years old.|", "Stone et al. wrote it.| Field et al. said so (n = 9).| By Wood et al. 5 were found.| Reed et al. Moor knew.|".replace(" Reed et al. Moor knew.|", ""), "Made by Hill Inc. in May.| Dale Ltd. sold it.| Dept. heads met at approx. 8.| The max. value and the min. value differ.|",
    "Es wog ca. 4,5 kg.| Viele Tiere, z. B. Katzen, schlafen.| Das gilt z. B. Montag oder z.B. heute.| Der Chef, d. h. Anna, ging.| Es sind d. h. 5 oder ca. ,5 m.| Tee bzw. Kaffee ist da.|", "Er kam u. a. mit Brot.| Sie nahm u.a. Käse, evtl. auch Obst.| Das Haus vs. Zelt war klar.| Es ist ggf. zu groß und inkl. Steuer, vgl. Haus 3 und sog. Hof.| Am 2. Juni kam er.| Am 17. August ging er.| Das 3. Rad brach.|",
    "Le prix, env. 12 euros, monte.| Un fruit, p. ex. la poire, pousse.| Voyez p. ex. LD6.| Le sol (cf. carte) est sec, cf. Moor.| Il pèse env. ,5 kg.|", "Pesa aprox. 3,5 kg.| Una fruta, p. ej. la pera, cae.| Usa p. ej. RT4.| Mide aprox. ,8 m (cf. Luna).| La casa de EE. UU. es grande.|",
    "Птица, т. е. гусь, летит.| Это т.е. Мир.| Вес ок. 3 кг и ок. ,5 м.| Один плод, напр. груша, упал.| Тов. Белов спит.| Д-р Орлов и проф. Лесов ушли.| В г. Туле снег.| Им. Ленина парк.|",
    # words that may end a sentence and may not
    "We bought nails, rope, etc.| The shop closed.| Nails, rope, etc. were sold.| We took pots, pans, etc.| “Is it enough?” asked Dr. Hill.|", "Bring cups, plates, etc. and come.| Cups, plates, etc.| qRT5 was sold.| They had milk, tea, etc.|\nThe rest was water.| They sold tea, etc.| 9 were left.|",
    "It opens by 8 a.m. and shuts at 6 p.m.| The guard left.| We ate at 1 p.m.| 20 of 50 came.| At 9 a.m. they slept.|", "We met at 7 p.m.| (The hall was dark.)| She rose at 5 a.m.| kVA fell.| It rang at 3 p.m.|\nNo one came.| From 2 a.m. to 4 p.m. it rained.|",
    "He works for Dale Co.| She works for Hill Co. in town.| He is John Jr.| He lives in the U.S.| She left the U.S. in May.| The U.S. Army came.|",
    "Wir sahen Kühe, Schafe usw.| Der Hof war groß.| Kühe, Schafe usw. schliefen.| Es gab Milch, Käse usw.| „War er gut?“, fragte Dr. Baum.| Er nahm Holz etc. mit.| Er nahm Holz etc.| Dann ging er.|", "On voit des pins, des ifs, etc.| La forêt est belle.| Des pins, des ifs, etc. poussent.|", "Hay vacas, ovejas, etc.| El campo es verde.| Vacas, ovejas, etc. duermen.|",
    "Там гуси, утки и др.| Пруд тих.| Гуси, утки и др. спят.| Купили хлеб, сыр и т. д.| Ночь пришла.| Хлеб, сыр и т. д. лежат.| Взяли сыр и др.| «Где хлеб?» — спросил д-р Белов.| Это было в 1990 г.| Потом он уехал.|",
    # ellipsis
    "The wind dropped ... and rose again.| He paused ... and\nwent on.| The light went out …| The guests left.| Is she home…?| No.|", "She waited... then she slept.| It was over...| The train left.| He slept ... The night passed.|".replace("slept ... The", "slept ...| The"),
    "雪停了……后来又下了。| 车慢了……然后停了。|", "雪が止んだ……そしてまた降った。| 汽車が遅れた……やがて着いた。|",
    # questions and exclamations
    "Who took the key?| Nobody knew!| Was it you?!| 6 of 9 said no.| Why run?| xMR7 waited.| Really?| (The hall was dark.)|", "Did it stop…?| The bell rang.| No boat came back!| bRT4 was lost.| What a night!| She laughed.|",
    "Wer rief an?| Das Fenster war zu.| Halt!| Alle blieben stehen.|", "¿Quién llamó?| ¡La torre cayó!| ¡Qué noche!| ¿Dónde está?| La mesa es grande.|", "Qui a crié ?| La lampe tombe ;la nuit vient.| Quel bruit !| Le chien dort ; le chat aussi.|".replace(" ;la", " ; la"), "Кто звонил?| Окно закрыто!| Где ключ?| Он тут.|",
    # reported speech: the sentence goes on behind the quotation, or ends with it
    "“Will it snow?” asked Mrs. Hill.| “Is KD8 ready?” asked Prof. Dale.| “Stop!” cried the guard.| “We are late,” said Ann.|", "The sign said: “The pool is shut.”| We left.| The sign said: “The pool is shut.”| No one swam.| She wrote: “It rained.”| “Will it stop?” asked he.|",
    "The note read: “The car broke.”| 12 of 20 walked.| The note read: “It broke.”| tGV3 came.| The note read: “It broke.”| (We walked.)|", "The card said: “It closed.”|\nWe went home.| The card said “closed.”| We read it.|", "He wrote: “Come. Do not wait.”| She came.| They wrote: “It is cold. It snows.”| Then it stopped.|",
    "She said “No. Never. Go home!” and left.| The word “end.” stood there.| A man (“Who? Me?”) laughed.|", "„Kommt der Zug?“, fragte Prof. Stein.| „Ist das Tor zu?“, fragte Dr. Blum.| Er schlief.| Auf dem Schild stand: „Das Bad ist zu.“| Wir gingen.|",
    "«Где поезд?» — спросил д-р Белов.| «Кто пришёл?» — спросила она.| Дом тих.| Он написал: «Снег идёт.»| Стало темно.|", "M. Roux écrit : « Le train part. »| La gare est vide.| « Le train part ? » dit Mme Blanc.| Elle écrit : « Il neige. »| Pourquoi ?| « Il neige ? » demande M. Dubois.|",
    "El Sr. Campo dijo: «El tren salió».| La calle calla.| La Dra. Rosa dijo: «Nieva mucho».| ¡Qué frío!| «¿Nieva?», dijo Luna.|",
    "「駅は遠いか？」という声がする。| 「駅は遠い。」と母は言った。|道は長い。|なぜ犬は鳴くのか？|雪が降った（5cm）。|「犬が鳴いた。」と彼は言った。|", "花は赤い。|「花は赤いか？」という声がする。|「鳥は飛ぶ。」と父は言った。|春が来た。|", "紙に「駅は閉まった。」とある。|誰もいない。|",
    "“车来了吗？”老人问道。|“天黑了吗？”孩子问道。|信上写道：“车来了。”|我们走了。|信上写道：“天黑了。”“车来了吗？”老人问道。|", "天黑了！|为何停车？|信上写道：“车停了。”|为何不走？|“菜熟了吗？”母亲问道。|“鱼大吗？”他问道。|鱼很大（2.5公斤）。|", "信上写道：“门开了。”\n我们走了。|信上写道：“门开了。” The shop closed.| 灯灭了。| The night came.|",
    # several sentences quoted inside a longer one
    "The guide told us “Wait here. The bridge is wet. Walk slowly.” and went ahead.| We waited.|", "Ann read “Rain came. It stayed. Nobody slept” aloud.| Ben slept.|", "Their song “Up we go. Down we fall. Up again!” was sung twice.| It ended.|", "He shouted “Stop! Who is there? Answer me!” into the dark.| No one spoke.| She whispered “It is I. Do not shoot. Please.” and came out.| They laughed.|",
    "Er rief „Halt! Wer ist da? Antworte!“ und wartete.| Sie kam.|", "Elle lit « Il neige. Il vente. Il gèle. » puis dort.| La nuit passe.|", "Он крикнул «Стой! Кто идёт? Ответь!» и ждал.| Тихо.|", "Leyó «Llueve. Nieva. Hiela.» y calló.| Nadie habló.|", "他说“天黑了。门开着。快走！”就离开了。|我们跟着他。|", "彼は「雨だ。風だ。帰ろう。」と叫んで走った。|母は待った。|",
    # brackets
    "(The shop was shut.)| The street was dark.| (Nobody was there.)| 21 of 30 left.| It was late (see Fig. 8).| Then it snowed.|", "(It rained.)| “Will it stop?” asked Ann.| (It rained.)| nBK5 was wet.| The hall [sic.] was dark.| He sang (badly. Loudly. Long) and left.|", "(A first one.) (A second one.)| The end.|".replace(".) (", ".)| ("),
    # semicolons and colons join
    "The sum (a = 3; b = 4) is 7; the rest is lost.| It rose;\nthen it fell.| It rose; KT5 fell.|", "Three came: Ann, Ben and Cy.| One left: Ben.|",
    # Arabic, Urdu, Hindi, Amharic, Greek
    "القطار وصل.| هل البيت بعيد؟| الثلج نزل 3.5 مرة.| السوق مغلق.|", "جاء الرجل؛ ثم ذهب.| أين المفتاح؟| الشارع هادئ!| الليل طويل.|", "ٹرین آ گئی۔| کیا گھر دور ہے؟| برف 6.5 انچ گری۔| بازار بند ہے۔|", "वह घर गया।| क्या ट्रेन आई?| बर्फ़ 4.5 इंच गिरी।| बाज़ार बंद है।| वाह!| रात लंबी थी।|",
    "ባቡሩ መጣ።| ቤቱ ሩቅ ነው?| በረዶ 2.5 ጊዜ ወረደ።| ሌሊቱ ረጅም ነበር።|", "Το τρένο ήρθε.| Πού είναι το κλειδί;| Χιόνισε 3.5 ώρες.| Η νύχτα έπεσε.| Γιατί έφυγες;| Δεν ξέρω!|",
    # Thai: white space ends a sentence unless it touches a digit
    "รถไฟมาถึงแล้ว| บ้านอยู่ไกล| หิมะตก 5 ครั้ง| ตลาดปิดแล้ว|", "เขาซื้อปลา 12 ตัว| แม่ทำอาหาร| น้ำเย็น 4.5 องศา| เด็กหลับ|", "ฝนตกหนัก| ถนนเปียก 3 วัน| ทุกคนกลับบ้าน|",
    # line breaks and spaces between sentences of wide scripts
    "门开了。|\n我们走进去。|\n灯亮着！|\n谁在家？|\n没有人。| 茶凉了。| 猫睡了。|\nA train came.| 车走了。|", "雨が降る。|\n犬が走る。|\n駅はどこか？|\n道は長い。| 空は青い。| 母は眠る。|\nThe end came.| 花が咲く。|", "父亲回来了！|\n“饭好了吗？”他问道。|\n菜凉了。|\n信上写道：“灯灭了。”|\n夜深了。|",
    # names with initials after every kind of end
    "Who came?| J. Moor did.| What a day!| A. B. Stone slept.| Is it late…?| K. Lake left.| It cost 5.| M. R. Hill paid.| (It snowed.)| G. Wood left.|", "The sign said: “It is shut.”| P. Dale read it.| They sold tea, etc.| R. T. Field drank it.| It opens at 6 a.m.| N. Marsh came.|\nL. Ford left.|", "Pourquoi part-il ?| M. Dubois dort.| Quelle nuit !| M. Roux part.| Il part.| M. Blanc reste.|", "Did the lamp break?| H. K. West fixed it.| Was it Ann?| D. Banks knew.| Did it rain!| V. S. Snow came.|",
    # days and other ordinals in German
    "Am 2. Juni kam er.| Am 17. August ging sie.| Am 30. April schlief er.| Am 8. März fiel Schnee.| Am 11. Oktober brach das Rad.| Es waren 9.| Dann kam er.| Vom 4. Mai bis zum 6. Juli regnete es.| Das 3. Rad brach.| Am 21. Dezember war es kalt.|", "Wer kam am 5. Mai?| Am 6. Mai kam Anna.| Der Hof hat 12.| Sie sind alt.| Am 24. September zog er um.| Im 18. Jahrhundert stand es.| Er sah Kühe usw.| Am 13. Juli ging er.|",
    "Viele Vögel, z. B. Enten, schwimmen.| Man nimmt z. B. RD6.| Es geht z. B. Sonntag.| Ein Tier, z. B. Hund, bellt.| Es hilft, z. B. bei KT4.| Das Tor, d. h. Holz, brach.| Der Preis, z. B. 5, stieg.|",
    # a bracket or a number before the end, a number behind it
    "The share grew (1.2 to 3.4).|\n14 of 30 stayed.| It was late (see No. 5).| 20 of 60 left.| The ratio was 4.25.| 17 of 40 came.| It fell to 1,250.5.| 31 trains left.|", "The value was 0.5.|\n9 of 12 agreed.| The price was 20.| 6 of 8 paid.| The code is NB3.| 44 of 90 knew.|",
    # marks inside numbers after a word
    "La somme était de 12.450,5 francs.| Elle monta.| Le poids est de 3.120 kg.|", "Вес составил 3.120,5 кг.| Цена была 12.400 рублей.|", "Der Preis war 2.750,5 Euro.| La suma fue de 4.300,5 pesos.| It was 9.125 km.|",
    # leftovers of markup
    "K&auml;se fehlt.| Das Tor&nbsp;steht offen.|", "Caf&eacute; ferm&eacute;.| La rue&nbsp;dort.|",
]
