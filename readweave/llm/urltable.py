"""The labelled URLs that the URL filter learns from, written out by hand: hosts and paths of both kinds, hard cases among them."""

#: To be blocked: by their host, by their path, or by both.
BLOCK = """
grand-casino.com/ www.casinoroyal.net/play vegascasino.info/bonus/welcome lucky-casino.org/en/slots online.casino-palace.com/ cityguide.org/casino/free-spins m.mycasino.example/jackpot
poker-room.com/ www.pokerstakes.net/tables/high holdem-poker.org/join m.pokerden.info/ forum.example.net/poker/bonus-code allpoker.example/freeroll clubs.example.org/online-poker/casino
megaslots.com/ slots-heaven.net/spin freeslots.org/777 www.fruitslots.info/play-now hosting.example.com/slots/jackpot bigslots.example.net/ slotsparadise.com/real-money
jackpot-city.net/ www.superjackpot.org/win bigjackpots.com/ jackpotparty.info/bonus roulette-wheel.com/ www.liveroulette.net/casino roulettesystem.org/win-now euroroulette.info/ games.example.org/roulette/bonus
sportsbets.net/odds www.betsnow.com/ livebetting.org/tips betting-tips.info/ bookies-betting.com/free-bet www.superbets.org/ mybets.example/bonus cricketbetting.net/ bets365online.info/ sites.example.com/betting/odds bestbets.example.org/
gambling-den.com/ www.gamblingking.net/ onlinegambling.org/casino gambling.example.info/win pages.example.net/gambling/slots lottery-winners.info/claim www.biglottery.net/prize lotterytickets.com/win mail.example.org/lottery/you-won
viagra-online.com/ www.buyviagra.net/order viagra4u.org/ genericviagra.info/cheap shop.example.com/viagra/cheap cheapviagra.example/ cialis-store.net/ www.buycialis.com/order cialisgeneric.org/ blog.example.info/cialis/discount cialis4less.info/
dietpills.com/ www.pillsonline.net/buy pills-direct.org/order weightlosspills.info/ bluepills.example.net/ store.example.com/pills/no-prescription magicpills.org/ buypills.example/cheap
xanax-shop.com/ www.buyxanax.net/ xanaxonline.org/no-prescription cheapmeds.info/ meds-without-rx.com/order www.onlinemeds.net/cheap canadianmeds.org/ steroids-shop.com/ www.buysteroids.net/ legalsteroids.org/order gymsteroids.info/ files.example.net/steroids/buy
freeporn.com/ www.pornhall.net/videos porn-tube.org/ bestporn.info/hd pornmovies.example/free archive.example.com/porn/free hotporn.net/ static.example.org/porn/xxx-clips myporn.example.org/watch teenporn.info/
xxxvideos.com/ www.xxx-tube.net/ xxxmovies.org/free hotxxx.info/ media.example.com/xxx/free-porn cdn.example.net/xxx/video.html superxxx.example/ xxx-club.info/join
sexchat.com/ www.freesex.net/cams sex-video.org/ livesex.info/chat sexdates.example.net/ user.example.org/sex/videos hotsex.com/ sexshop-online.net/ bestsexcams.org/ phonesex.info/
nudepics.com/ www.nudecelebs.net/ nude-models.org/gallery hotnudes.info/ img.example.com/nude/gallery freenudes.example/ livecams.net/girls www.hotcams.com/ sexycams.org/live camsgirls.info/ webcams-adult.com/
escorts-city.com/ www.vipescorts.net/ escort-girls.org/ bookescorts.info/ ads.example.com/escorts/girls adultfriends.com/ www.adultvideos.net/ adult-chat.org/ adultdating.info/hookup adulttoys.example/shop adultmovies.com/ hot.example.net/adult/videos www.adult-clips.org/ myadult.info/ adultcams.example.net/
eroticstories.com/ www.erotic-films.net/ eroticmassage.org/ hoterotic.info/ milfhunter.com/ www.hotmilfs.net/ milf-dates.org/ hookup-tonight.com/ www.easyhookup.net/ hookups.info/adult fetishclub.com/ www.fetish-videos.org/ fetishcams.net/
warez-world.com/ www.freewarez.net/ warezbb.org/crack topwarez.info/ mirror.example.com/warez/keygen crackz.net/serials www.softcracks.com/ crackserial.org/download fullcrack.info/ dl.example.net/crack/keygen keygens.com/ www.keygen-archive.net/ freekeygen.org/ software.example.info/keygen/serials keygenguru.info/ cracked-games.net/ cracksoft.example/
torrentz.com/ www.freetorrents.net/ torrent-movies.org/ besttorrents.info/download share.example.com/torrent/movies alltorrents.example/ moviestorrent.net/ torrentking.org/
spamking.com/ www.spam-mailer.net/ spambot.org/ bulkspam.info/ mx.example.com/spam/bulk spamlists.net/buy massspam.example/ spam4cash.org/ spamworld.info/ emailspam.com/
adserver.com/click www.adserve.net/banner ads-network.org/ clickads.info/ popads.net/ go.example.com/ads/click.php adsbanner.example/ pop-ads.com/banner.js adsdelivery.org/ bannerads.info/track freeads.example.net/click www.ads-market.com/ adstream.org/ads.js cheapads.net/
popups.com/win www.popupads.net/ popup-traffic.org/ tracker-ads.com/pixel www.adtracker.net/ click-tracker.org/pixel.gif trackerpixel.info/ clicktrack.net/redirect usertracking.org/pixel www.trackclicks.com/ traffictrack.info/click tracking-pixel.net/ pixel.example.com/track/click
clickbaits.com/ www.clickbait-daily.net/ clickbaitnews.org/you-wont-believe malware-host.com/ www.malwaredrop.net/ malwarekit.org/download bad.example.info/malware/payload.exe phishing-kit.com/ www.phishingpage.net/login secure-phishing.org/ login.example.com/phishing/verify phish.example.net/account-verify
paydayloans.com/ www.payday-cash.net/ paydayadvance.org/apply fastpayday.info/ my.example.com/payday/loans easyloans-payday.com/ www.quickpayday.example/ paydaynow.net/ noloancheck-payday.org/
replicawatches.com/ www.replica-bags.net/ bestreplica.org/rolex replicas.info/ shop.example.net/replica/rolex luxuryreplica.example/ backlinks-seo.com/ www.buybacklinks.net/ cheapbacklinks.org/ seobacklinks.info/ linkfarm.com/ www.link-farm.net/ linkfarms.org/ contentfarm-spam.info/ ponzi-profits.com/ www.bitcoinponzi.net/ ponzi.example.org/invest doubleyourmoney.info/ponzi
spam-links.org/ bulk-spam.net/ spam-seo.com/ www.spam-sites.info/ spam-blog.example.net/ seo-spam.org/ spam-comments.com/ auto-spam.net/ spam-and-links.info/ spampages.org/
ads-click.com/ www.ads-banner.org/ ads-popup.net/ click-ads.info/ ads-pixel.example.com/ video-ads.net/ ads-redirect.org/ push-ads.com/ ads-clicks.info/ mobile-ads.net/ track-clicks.com/ click-track.org/ track-users.net/ ad-track.info/ track-pixel.com/
sex-tube.net/ sex-cams.org/ free-sex.info/ sex-chat.example.net/ xxx-porn.com/ xxx-cams.org/ free-xxx.net/ poker-slots.com/ online-poker.net/ poker-casino.org/ free-poker.info/ casino-online.com/ online-casino.net/ casino-slots.org/ casino-bonus.info/ lottery-prize.com/ win-lottery.net/ payday-loan.com/ loans-payday.net/ link-farms.net/ warez-crack.com/ crack-warez.net/ free-warez.org/ torrent-free.com/ free-torrent.net/ porn-free.org/ nude-girls.com/ nude-cams.net/ milf-porn.com/ milf-cams.org/ hookup-sex.com/ adult-sex.org/ adult-porn.net/
cv.example.org/porn/free me.example.com/casino/win u.example.net/viagra/buy a.example.com/poker/play docs.example.net/warez/download wiki.example.com/sex/cams web.example.org/lottery/prize p.example.com/pills/cheap x.example.org/payday/apply z.example.net/spam/links t.example.com/torrent/free n.example.org/phishing/login
casinopoker.example.com/ m.slotscasino.example.org/ big-casino.net/ www.bigcasinowin.org/ wincasino.example.net/ freebets.org/ www.free-betting.com/ getfreebets.info/ cheappills.net/ cheap-meds.org/ www.cheap-cialis.com/
"""

#: To be allowed. Many look like the above: track and field, Betty, Sussex, crackers, spamming reports, adsorption, pillows.
ALLOW = """
gardenclub.org/roses www.kitchengarden.com/recipes/soup herbgarden.net/ recipes.example.com/cakes/lemon familyrecipes.info/dinner baking-recipes.org/bread cookinglight.com/ slowcooking.net/stew www.grandmascookies.org/ cookery.example/en/12
history-museum.org/visit www.artmuseum.com/exhibitions museumofscience.net/ localhistory.info/archive historytoday.com/ railwaymuseum.example.org/ citylibrary.org/catalogue www.libraryofmaps.net/ statelibrary.info/opening-hours library.example.com/books/new schoollibrary.example/
highschool.org/news www.primaryschool.net/ musicschool.com/lessons schoolmeals.info/ drivingschool.example/ college.example.org/courses www.artcollege.com/ collegetown.net/ university-press.org/titles opencourses.net/physics campusnews.info/ students.example.com/timetable teachersnet.org/
physicsworld.com/ www.biologyonline.org/cells chemistry-lab.net/ mathsisuseful.com/algebra geologymaps.org/ astronomynow.net/moon www.climatedata.info/ sciencejournal.com/volume/12 research.example.org/papers openarchive.net/preprints quantumnotes.info/
weather.example.com/forecast/today www.stormwatch.org/ rainfallmaps.net/ torrential-rain.info/warnings www.torrentsriver.org/rafting mountainweather.com/ snowreport.net/ windmap.org/
trackcycling.org/results www.trackathletics.com/ raceway-track.net/tickets soundtracks.info/film tracksideview.com/ trackstudents.org/grades dirttrackracing.net/ sidetrack.org/blog racetrack-history.com/ fieldathletics.info/ runningtrack.example.com/ eighttracktapes.net/
betty-crafts.com/ www.bettysbakery.net/ bethanychurch.org/ alphabetgames.net/kids bettertogether.org/ www.betterhomes.info/ betagrid.com/docs tibetan-culture.org/ elisabethsdiary.net/ albertabetony.com/ bethesda-news.info/ bets-y-ross-house.org/ bettina-weaving.com/ abetterworld.net/ betsey-sews.org/
sussexwalks.org/ www.wessexarchaeology.com/ middlesexhistory.net/ sussex-gardens.info/ wessex.example.org/ middlesex-times.com/ asexual-plants.org/reproduction sextantnavigation.net/ unisexclothing.com/ sextonfamily.org/ sussexcricket.net/ esseker.org/ www.sussex-farms.com/ wessexwater.info/ southsussex.example.net/
crackersandcheese.com/ www.firecrackers-safety.org/ nutcrackerballet.net/ crackle-glaze.info/pottery wisecracks.org/ cracksinconcrete.com/repair biscuitcrackers.net/ keygenes.org/biology keyboardgeneral.com/ masonkeystone.net/
spamfilterguide.org/ www.antispam-research.net/ stopspam.info/howto spamalotmusical.com/ spanish-lessons.org/ grapesandjam.com/ sampling.example.net/ spamarrest.org/ spandau-ballet.net/
adsorption-science.org/ www.leadsinger.com/ broadstairs.net/ shadsfishing.info/ beadsandthreads.com/ roadsideflowers.org/ threads.example.com/ loadsofbooks.net/ nomadsland.org/ headstart.info/ adstock-village.org/ readsomething.net/ broadsheet.com/
pillowsandquilts.com/ www.pillsburyhistory.org/ caterpillars.net/ spillsafety.info/ pillars-of-salt.com/ medsci.org/journal medschool.net/ mediterranean-food.com/ medstudents.info/ comedsketch.org/ pharmacyschool.net/ pharmacy-museum.org/ hospitalnews.com/ www.nursinghome.info/ clinicfinder.org/
popularmechanics.net/ www.popupbooks.org/children pop-music-history.com/ popupmuseum.info/ dolphintrackers.org/ trackertalk-birds.net/ animaltracks.com/ birdtracking.org/migration
slotcars.com/ www.timeslotplanner.net/ slotcarracing.org/ mailslot.info/ toaster-slots.net/repair pokerwork-craft.org/ firepoker.net/ rouletabille-books.com/ casinorleans.net/ cassino-abbey.org/ jackpotatoes.com/ jackpottery.org/ bingohallhistory.org/ gamblelandscape.net/
adulteducation.org/ www.adultliteracy.net/ adult-learning.info/courses adulteducators.com/ youngadultbooks.org/ adultswimming.net/ nudefoodgarden.com/ cambridgecams.org/mechanics camshafts.net/ camsandgears.com/ escortcarclub.net/ fordescort.org/ milford-haven.com/ milfoil-plants.org/ eroica-symphony.net/ farewellparty.org/ replicaship.org/museum replica-fossils.net/ softwarezone.com/ hardwarezone.net/ wareham-town.org/
financialnews.com/ www.studentloans.org/ loansharkmuseum.net/ homeloans.info/ library-loans.org/ paydaylight.net/ banking.example.com/ accountingtoday.org/ farmlinks.net/ organicfarm.org/ windfarm.info/ linksgolf.com/ farmersmarket.net/ dairyfarm.com/ farmhouse-inn.org/ sunnyfarm.example.com/ www.fishfarm.net/
winterhiking.com/ www.windowcleaning.net/ winemaking.org/ wintergarden.info/ cheapflights-guide.com/ freedomtrail.org/ freelancewriters.net/ cheeseshop.com/ freestyle-skiing.org/ freshbread.net/ clickclock.com/ wincanton.org/ winslow-homer.net/ freewheel-cycling.com/ cheapside-london.org/ cheaprecipes.net/ freebooks.org/classics freemaps.net/
musicfestival.org/ www.orchestra.com/ theatreroyal.net/ cinemaclub.info/ paintingclass.com/ poetryfoundation-north.org/ novelists.net/ chessclub.com/ footballhistory.org/ rugbyunion.net/ tennisclub.info/ swimmingpool.com/ cyclingroutes.org/ hillwalking.net/ sailingschool.com/ rowingclub.org/
daily-herald.com/ www.thetribune.net/ morningcourier.org/ gazetteonline.info/ theguardianangel.com/ newsletters.org/ thehinterland.net/ northshore.com/ thetford-town.org/ thornbury.net/ www.thanetcoast.info/ theron-music.org/ theringsmith.com/ therapyrooms.net/ thessaly-tours.org/ thatchedroofs.com/ shethlandponies.net/ tonsberg-harbour.org/ nationalpark.com/ stationery-shop.net/ intherivers.org/ hennadesigns.com/ andersonlandscapes.net/ bleuets.org/ renaissance-fair.com/ esterhazy.net/ ondine-opera.org/
softwareengineering.org/ www.opensourcedb.net/docs compilerdesign.com/ programmingblog.info/2021/05/post robotics-club.org/ networkbasics.net/ databasetheory.com/ linuxnotes.org/ pythontutorial.net/ webdesign.example.com/ forum.example.org/questions/512 wiki.example.net/page/7 blog.example.com/fr/77 docs.example/en/4821.html
towncouncil.org/minutes www.electionresults.net/ parliament-history.com/ embassyguide.info/ railwaystation.org/timetable airportparking.net/ harbourmaster.com/ shippingnews.org/ insurance-advice.net/ postoffice.info/ firestation.com/ policehistory.org/
puppytraining.com/ www.kittenrescue.org/ horseriding.net/ birdwatching.info/list aquariumworld.com/ beekeepers.org/ sheepdogs.net/ wildflowers.com/ oakforest.org/ rivertrout.net/ islandferries.com/ mountainhuts.org/ valleyfarm.info/ lakeside-camping.net/
hosting.example.com/plans files.example.net/reports/2020 static.example.org/css/site.css archive.example.com/newspapers/1912 img.example.com/flowers/tulip.jpg cdn.example.net/fonts/serif.woff media.example.com/lectures/week3 dl.example.net/maps/trails mirror.example.com/linux/readme share.example.com/notes/garden mx.example.com/status store.example.com/books/history shop.example.com/lamps/desk shop.example.net/boots pages.example.net/family/reunion games.example.org/chess/openings sites.example.com/choir/concerts mail.example.org/help clubs.example.org/rowing cityguide.org/churches user.example.org/photos/harbour login.example.com/help my.example.com/calendar go.example.com/library gambling-free.example.info/help software.example.info/editor/manual forum.example.net/gardening/compost
cv.example.org/education me.example.com/photos/summer u.example.net/maps/north a.example.com/lessons/piano docs.example.net/manual/start wiki.example.com/rivers/danube web.example.org/concerts/june p.example.com/recipes/soup x.example.org/trains/times z.example.net/poems/winter t.example.com/temples/kyoto n.example.org/notes/botany
evening-classes.org/ night-train.net/ village-green.com/ stone-bridge.org/ old-mill.info/ city-walks.net/ paper-boats.com/ green-energy.org/ north-wind.net/ solar-panels.info/ wooden-toys.com/ apple-orchard.net/ red-kite.org/ blue-whale.info/ river-cruise.com/ silver-birch.net/ summer-school.org/ winter-coats.com/ spring-flowers.net/ autumn-leaves.info/ language-course.com/ piano-teacher.net/ guitar-chords.org/ violin-lessons.info/ choir-practice.com/ dance-studio.net/ film-archive.org/ photo-album.info/ travel-diary.com/ bike-repair.net/ car-museum.org/ train-models.info/ sea-kayak.com/ ski-resort.net/ hotel-garden.org/ museum-shop.info/ kids-science.com/ plant-names.net/ tree-nursery.org/ bread-oven.info/ cheese-board.com/ tea-ceremony.net/ honey-bee.org/ fish-market.info/ rice-fields.com/ corn-exchange.net/ water-lilies.org/ fire-brigade.info/ earth-science.com/ moon-phases.net/ star-charts.org/ rain-gauge.info/ snow-shoes.com/ ice-skating.net/ tall-ships.org/ light-house.info/
bakeryonmain.com/ www.coffeeroasters.net/ teahouse.org/ furnituremakers.info/ carpentry-tips.com/ printingpress.org/ bookbinding.net/ knitting.example.com/patterns toymuseum.org/ stampcollecting.net/ clockmaker.com/ pottery-wheel.org/ sewingcircle.info/ lampshades.net/
"""


#: Beginnings and ends of hosts, and paths, that tell nothing.
PREFIXES = ("", "www.", "m.", "blog.", "news.", "online.")
SUFFIXES = (".com", ".org", ".net", ".info", ".example.com", ".example.org", ".example.net", ".example")
PATHS = ("/", "/en/{}.html", "/fr/{}/", "/de/{}", "/es/{}.html", "/2021/05/first-post", "/index.php", "/about", "", "/en/{}", "/de/{}/", "/es/{}")


def varied(rows: list[tuple[str, str, int]], times: int = 4) -> list[tuple[str, str, int]]:
    """Each row and its like under other beginnings and ends of hosts, going round alike under both labels, so that these tell nothing.

    A bare path becomes one of those that tell nothing; where a path says what a URL is, it stays.
    """
    out = list(rows)
    for label in (0, 1):
        for k, (host, path, _) in enumerate(r for r in rows if r[2] == label):
            name = next((host.removeprefix(p) for p in PREFIXES[1:] if host.startswith(p)), host)
            name = name.removesuffix(max((s for s in SUFFIXES if name.endswith(s)), key=len, default=""))
            for i in range(times):
                other = PATHS[(k + i) % len(PATHS)].format((k + 1) * (i + 3) * 7919 % 99_991) if path == "/" else path
                out.append((PREFIXES[(k + i) % len(PREFIXES)] + name + SUFFIXES[(k // 2 + i) % len(SUFFIXES)], other, label))
    return out


def rows() -> list[tuple[str, str, int]]:
    """Host, path and 1 to block or 0 to allow."""
    cut = lambda u: (u[: u.find("/")], u[u.find("/") :])
    return [(*cut(u), label) for label, urls in ((1, BLOCK), (0, ALLOW)) for u in urls.split()]
