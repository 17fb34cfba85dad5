from querymill.plans.pipeline import main

main()
